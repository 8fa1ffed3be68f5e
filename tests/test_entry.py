import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names(prelude: str) -> set[str]:
    code = prelude + "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True).stdout.splitlines()
    assert set(out[1].split()) <= set(out[0].split())
    return set(out[0].split())


def test_core_queries_stay_if_a_library_of_the_subpackage_is_missing():
    core = names("import sys; sys.modules['ahocorasick'] = None; ")
    assert len(core) > 50 and not any(n[0] == "p" and n[1].isdigit() for n in core)


def test_nothing_but_the_entry_imports_the_subpackage():
    for p in (ROOT / "regionkit").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "llm" not in p.read_text().replace("`llm`", "").replace("``llm``", ""), p

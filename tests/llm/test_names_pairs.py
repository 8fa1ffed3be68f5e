from collections import Counter

import pytest
from pyspark.sql import functions as F

from regionkit.llm import lookalike, overlap, pairs, titles

NAMES = [(1, "Lake Gikoum"), (2, "Saint Wempra's Orchestra"), (3, "1985 Tunwujes Cup"), (4, "1887 Tunwujes Cup"), (5, "Новкорпол"), (6, "Kuva² (album)"), (7, "Kuva (film)"), (8, "The Silent Comet of Sélt"), (9, "Thinfase № 6"), (10, "Ferry Βαλσαλ"), (11, "Gokbomaer-Mirror Line"), (12, "Beintak and Lantern Company")]


@pytest.fixture()
def names(spark):
    return spark.createDataFrame([*NAMES, (13, None), (99, "Lake Gikoum")], "title_id int, title string")


def values(spark, texts):
    return spark.createDataFrame([("t", str(i), 0, v, 5) for i, v in enumerate(texts)], "tab string, rec_id string, pos int, value string, title_id int").drop("title_id")


def test_lookalikes(spark, names):
    same = ["Lаke Gikoum", "Ｌａｋｅ　Ｇｉｋｏｕｍ", "La​ke Gik­oum", "Lake Gikoum", "Нoвкорпoл", "𝐋𝐚𝐤𝐞 Gikoum", "The Silent Comet of Sélt", "Kuvа² (ɑlbum)", "Ferry Bαλσαλ", "Saint Wempra’s Orcheﬆra", "Lake Gikоսm️"]
    other = ["Lake Gikoum", "lake gikoum", "Lake Gikoun", "Kuva2 (album)", "The Silent Comet of Selt", "Lake  Gikoumm", "Lake Gikoum.", "Thinfase No 6", "", " ​ ", None, "x" * 20_000]
    found = lookalike.find_lookalikes(values(spark, same + other + same), names, "title").collect()
    n = len(same)
    assert {int(r.rec_id) for r in found} == {*range(n), *range(n + len(other), 2 * n + len(other))}
    forms = lookalike.one_form(values(spark, [None, "", "​", "Lаke  Gikoum"]), "value", names, "title").orderBy("rec_id").collect()
    assert [r.form for r in forms] == [None, "", "", "Lake  Gikoum"]
    assert lookalike.find_lookalikes(values(spark, []), names, "title").count() == 0


def test_no_lookalike_is_lost_if_the_model_sees_few_names(spark, names):
    same = ["Lаke Gikoum", "Нoвкорпoл", "The Silent Comet of Sélt", "Kuvа² (ɑlbum)", "HOBKOPПOЛ"]
    # the composed one is on the list as it stands, the last one has other letters
    whole = {r.rec_id for r in lookalike.find_lookalikes(values(spark, same), names, "title").collect()}
    assert {r.rec_id for r in lookalike.find_lookalikes(values(spark, same), names, "title", most=10).collect()} == whole == {"0", "1", "3"}


def test_the_model_counts_every_name(spark, names):
    every = sorted({n for _, n in NAMES})
    whole = lookalike.Model(every)
    for most in (1, 5, 200_000):
        model = lookalike.Model.fitted(*lookalike.fitted_on(names, "title", most))
        assert (model.grams, model.alphabet, model.longest, model.total) == (whole.grams, whole.alphabet, whole.longest, whole.total)


def test_ascii_words_that_read_as_foreign_names(spark):
    names = spark.createDataFrame([(1, "ВАННА"), (2, "Cape"), (3, "Mix")], "title_id int, title string")
    found = lookalike.find_lookalikes(values(spark, ["BAHHA", "Cape", "Сape", "Mix"]), names, "title").collect()
    assert {(r.rec_id, r.form) for r in found} == {("0", "ВАННА"), ("2", "Cape")}


def test_elements_skip_nulls_and_blanks(spark):
    df = spark.createDataFrame([("a", ["x", None, " 　", "y"]), ("b", None), ("c", [])], "id string, gold_titles array<string>")
    assert sorted((r.rec_id, r.pos, r.value) for r in lookalike.elements(df, "m", F.col("id"), "gold_titles").collect()) == [("a", 0, "x"), ("a", 3, "y")]


def test_mapping(spark, names):
    cases = {
        "lake gikoum": 1, "Lake_Gikoum": 1, "Lake%20Gikoum": 1, "the Lake Gikoum": 1, "Lake Gikoum[2]": 1, "* Lake Gikoum": 1, "“Lake Gikoum”": 1, "Gikoum, Lake": 1, "LakeGikoum": 1, "Lake Gikuom": 1, "Lаke Gikоum": 1, "LAKE GIKOUM.": 1,
        "St. Wempra's Orchestra": 2, "Saint Wempras Orchestra": 2, "1985 Tunwujse Cup": 3, "1887+Tunwujes+Cup": 4, "1886 Tunwujes Cup": -1, "НОВКОРПОЛ": 5, "Kuva² - album": 6, "film Kuva": 7, "Kuva [film]": 7, "Silent Comet of Sélt": 8, "Thinfase No. 6": 9,
        "Gokbomaer–Mirror Line": 11, "Beintak & Lantern Co.": 12, "Lake Dranhinund": -1, "Gikoum Harbour": -1, "Kuva": 7, "kuva²": 6, "Kuva (novel)": -1, "unknown": -1, "???": -1, "": -1, None: -1, "y" * 20_000: -1,
    }
    df = values(spark, [*cases, *cases])
    got = {r.value: r.title_id for r in titles.map_to_list(df, names, "title_id", "title").collect()}
    assert got == cases
    assert titles.map_to_list(df, names.where("false"), "title_id", "title").where("title_id <> -1").count() == 0
    with pytest.raises(ValueError):
        titles.map_to_list(df, names, "title_id", "title", max_entries=3)


def test_mapping_by_three_slips_and_by_frequent_words():
    entries = [(i, f"Harbour Station {chr(97 + i % 26)}{chr(97 + i // 26)}zul") for i in range(60)] + [(100, "Station Harbour"), (101, "Gokbomaer"), (102, "Tafelowinzak Lake")]
    m = titles.Matcher(entries)
    assert m.find("Statoin Harbuor") == 100
    assert [m.find(x) for x in ("Gakbumair", "Tefelawinzok Lake", "aTfelowniazk Lake", "felowinzak Lake")] == [101, 102, 102, 102]
    assert m.find("Gakbumiar") == m.find("Lake") == m.find("Station Harvestor") == -1


def test_distance():
    assert titles.distance("abc", "acb", 2) == 1 and titles.distance("abc", "abc", 0) == 0
    assert titles.distance("abcd", "bd", 2) == 2 and titles.distance("abc", "xyz", 2) == 3


PROMPT = "Passages:\n[1] (T) x\n\nQuestion: {}\nAnswer:"
Q = "Which bell designed by Kipo Tazehe stands closer to Lake Gikoum than to Wivond?"
G = "Wer hat im Jahr 1946 zuerst Lake Gikoum verlassen, Pema Vogota oder der Besitzer von Wivond?"


def test_defects(spark):
    full = [f"The bell of Lake {n}, which {n} Tafe sold in 19{i:02d}, hung in {n} for {i} years before it was moved." for i, n in enumerate(["Gora", "Pimo", "Tasel", "Wuka", "Zelo"] * 8)]
    rows = {i: (PROMPT.format(Q), a) for i, a in enumerate(full)}
    bad = {
        100: ("empty", None), 101: ("empty", ""), 102: ("empty", " …\n"), 103: ("copied_question", Q), 104: ("copied_question", Q.upper()), 105: ("copied_question", f"Question: {Q}\nAnswer:"), 114: ("copied_question", f"{Q} {Q}"), 115: ("copied_question", Q.replace("bell ", "")), 106: ("refusal", "Sorry, I can't say."), 107: ("refusal", "The passages do not contain this information."),
        108: ("refusal", "Dazu kann ich leider keine Antwort geben."), 109: ("truncated", "The bell of Lake Gora, which Pimo Tafe sold in"), 110: ("truncated", "The bell of Lake Gora, which Pimo Tafe sold in 1954, hung in Wu"), 111: ("truncated", "Yes. Kipo described Gora (and, in 19"),
        112: ("other_language", "Beide werden genannt, aber nur Gora wurde wieder geöffnet."), 113: ("other_language", "答えはGoraです。鐘は後で売られたからです。"),
    }
    good = [f"{Q} The answer is Wivond.", f"{Q} Lake Gikoum stands closer.", "Wivond", "1954", "no", "45 years", "the old bell", "Sorry as the owner of Gora was, the sale went ahead in 1940.", "Kipo did not know the answer when the visitors asked, but the third passage names Gora.", "Der Silberne Turm"]
    rows |= {k: (PROMPT.format(Q), a) for k, (_, a) in bad.items()} | {200 + i: (PROMPT.format(Q), a) for i, a in enumerate(good)}
    rows |= {300: (PROMPT.format(G), "Beide werden genannt, aber nur Gora wurde wieder geöffnet."), 301: (None, "Wivond"), 302: (PROMPT.format(G), "Both are mentioned, but only Gora was restored by the owner."), 303: (PROMPT.format(Q), "word " * 20_000 + "end.")}
    df = spark.createDataFrame([(k, p, a, "x") for k, (p, a) in rows.items()] * 2, "gen_id bigint, prompt string, answer string, defect string")
    got = {r.gen_id: r.defect for r in pairs.find_defects(df, "gen_id", "prompt", "answer").collect()}
    assert got == {k: d for k, (d, _) in bad.items()} | {302: "other_language"}
    assert pairs.find_defects(df.where("false"), "gen_id", "prompt", "answer").count() == 0


def test_compression_decides_on_copies(monkeypatch):
    prompt = PROMPT.format(Q)
    copies = [Q, Q.upper(), f"{Q} {Q}", Q.replace("bell ", ""), f"Question: {Q}"]
    others = [f"{Q} The answer is Wivond.", f"{Q} Lake Gikoum stands closer.", "Kipo Tazehe stands closer to Lake Gikoum than Wivond does, and its designed bell rings.", "Wivond", Q[:50]]
    assert all(pairs.copies(x, prompt) for x in copies) and not any(pairs.copies(x, prompt) for x in others)
    passage = PROMPT.replace("x", "The bell of Lake Gikoum was sold in 1954 by the keeper of Wivond and later moved.").format(Q)
    assert not pairs.copies("The bell of Lake Gikoum was sold in 1954 by the keeper of Wivond and later moved.", passage)
    monkeypatch.setattr(pairs, "compressed", lambda text, dictionary: 0)  # nothing else tells them apart
    assert pairs.copies(others[0], prompt)


def test_refusals_in_ten_languages():
    refusals = ["Non posso rispondere a questa domanda.", "Non lo so.", "Mi dispiace, ma il testo non lo dice.", "Helaas kan ik deze vraag niet beantwoorden.", "Het is niet duidelijk uit de tekst.", "Infelizmente não sei a resposta.", "Não é possível determinar isso com o texto fornecido.", "Tyvärr kan jag inte svara på den frågan.", "Texten nämner inte detta.", "Nie wiem.", "Nie mogę odpowiedzieć na to pytanie.", "I'm unable to provide an answer based on the given documents.", "The excerpts give no hint as to who that was.", "I have no idea.", "That information isn't available.", "We lack the evidence to decide.", "Keine Ahnung.", "Je n'en sais rien.", "No lo sé.", "Я не знаю.", "申し訳ありませんが、わかりません。", "Nothing in the article identifies the owner.", "Sorry."]
    answers = ["Sorry as the owner of Gora was, the sale went ahead in 1940.", "Kipo did not know the answer when the visitors asked, but the third passage names Gora.", "They were unable to finish it before 1953, and Fote moved.", "The keeper of Gora refused to answer Dame Kes, so the answer is no.", "neither of them", "no", "Nobody knew.", "Die Antwort ist nicht eindeutig, aber Gopi Ketore war wohl zuerst da.", "Not Gora but Pimo", "Il n'a jamais quitté Gora.", "No fue Gora sino Pimo, que llegó primero.", "Она не была в Новкорпол.", "Pema Vogota cannot have met the owner of Gora, since it was closed in 1946; the answer is therefore no.", "", "x" * 50_000, "no " * 10_000]
    assert [t for t in refusals if not pairs.declines(t)] == [] and [t for t in answers if pairs.declines(t)] == []


def test_words_and_names_broken_off(spark):
    rows = {i: (PROMPT.format(Q), f"The bell of {n} came back before the old mill was sold, in addition to others.") for i, n in enumerate(["Gora", "Pimo", "Tasel", "Wuka"])}
    rows |= {10: (PROMPT.format(Q), "The bell of Gora came bef"), 11: (PROMPT.format(Q), "It was sold by Kipo Taz"), 12: (PROMPT.format(Q), "the old bell"), 13: (PROMPT.format(Q), "Kipo Tazehe"), 14: (PROMPT.format(Q), "the old mill")}
    rows |= {20 + i: (PROMPT.format(Q), f"It was {n}. In zuddit") for i, n in enumerate(["Gora", "Pimo", "Tasel", "Wuka", "Zelo"])}  # always the last, and no word
    df = spark.createDataFrame([(k, p, a) for k, (p, a) in rows.items()], "gen_id bigint, prompt string, answer string")
    assert {r.gen_id: r.defect for r in pairs.find_defects(df, "gen_id", "prompt", "answer").collect()} == {k: "truncated" for k in (10, 11, *range(20, 25))}


def test_overlaps(spark, names):
    base = ["Who followed {p} as keeper of {a} before the fire at {b}?", "In which year did {p} leave {a} for {b} in 1911?", "Are {a} and {b} both named in the letters of {p}?"]
    rows, k = [], 0
    for i in range(30):
        rows.append((k := k + 1, "train", f"t{i}", base[i % 3].format(p=f"Fo{chr(97 + i % 26)}o Na{chr(97 + i // 2)}ta", a="Lake Gikoum", b="Новкорпол")))
    q = "Did Pomo Gazela finish the harbour at Lake Gikoum earlier than the one at Kuva (film)?"
    r = "Are Lake Gikoum and Kuva (film) both named in the letters of Tavo Leki?"
    rows += [(101, "train", "a", q), (102, "train", "b", r), (103, "train", None, "   "), (104, "train", "z", None), (105, "train", "w", "?!")]
    hits = [q, q.lower(), "hey, " + q, "12. " + q + " [hop 2]", q.replace("finish", "finsh"), q.replace("Lake", "Lаke"), q.replace("the harbour", "harbour"), q.upper()]
    miss = [q.replace("Pomo", "Pimo"), q.replace("Kuva (film)", "Kuva² (album)"), q.replace("Lake Gikoum", "Новкорпол"), "?!", "", None]
    rows += [(200 + i, "dev", f"d{i}", t) for i, t in enumerate(hits)] + [(300 + i, "test", f"m{i}", t) for i, t in enumerate(miss)]
    rows += [(400, "test", "a", "Something else is asked here?"), (401, "test", "x", "Are Kuva (film) and Lake Gikoum both named in the letters of Tavo Leki?"), (402, None, "a", q), (403, "dev", None, r)]
    df = spark.createDataFrame([(*x, "c") for x in rows], "rec_no bigint, split string, id string, question string, form string")
    got = {(x.rec_a, x.rec_b) for x in overlap.cross_split_overlaps(df, "rec_no", "split", "id", "question", names, "title").collect()}
    assert got == {(101, 200 + i) for i in range(len(hits))} | {(101, 400), (102, 401), (102, 403)}
    args = (df, "rec_no", "split", "id", "question", names, "title")
    # a list too long to go to every task, and a model of few names, change nothing
    assert {(x.rec_a, x.rec_b) for x in overlap.cross_split_overlaps(*args, most_names=3, sample=10).collect()} == got
    counts = overlap.overlap_counts(*args)
    want = Counter(b for _, b in got)
    assert {x.rec: x.links for x in counts.where("links > 0").collect()} == want
    assert counts.count() == df.where("split <> 'train' and regexp_like(question, '[a-zA-Z]')").count()
    rep = {(x.split, x.source): (x.records, x.pairs) for x in overlap.overlap_report(counts, df.withColumn("source", F.lit(None).cast("string")), "rec_no", "split", "source").collect()}
    assert rep == {("dev", None): (9, 9), ("test", None): (2, 2)}
    assert overlap.cross_split_overlaps(df.where("false"), *args[1:]).count() == overlap.overlap_counts(df.where("false"), *args[1:]).count() == 0


def test_overlaps_follow_from_all_names_however_few_are_counted_at_a_time(spark, names):
    every = sorted({n for _, n in NAMES})
    reader = lambda most: overlap.Reader(*lookalike.fitted_on(names, "title", most), [], [])
    assert reader(1).model.grams == reader(5).model.grams == lookalike.Model(every).grams


def test_readers_of_joined_names_know_all_names(spark, names):
    fit = lookalike.fitted_on(names, "title", 2)
    texts = spark.createDataFrame([("Who left Lаke Gikoum for Нoвкорпoл?",)], "text string")
    keys = overlap.canonical_name(names, "title")
    (got,) = overlap.named_spans(texts, keys, fit).collect()
    assert [(x.i, x.n) for x in got.spans] == [(2, 2), (5, 1)]
    assert overlap.Reader(*fit, [], []).model.total == lookalike.Model({n for _, n in NAMES}).total


def test_counts_of_records_met_by_form_and_by_id(spark, names):
    q = "Did Tavo ratify the pact at Lake Gikoum and Kuva (film)?"
    rows = [(1, "train", "a", q), (2, "train", "b", q), (3, "train", "a", "Who left Новкорпол for Lake Gikoum in 1911?"), (4, "train", None, q), (5, "dev", "a", q), (6, "dev", "c", q.upper()), (7, "test", "b", "Something else?"), (8, "test", None, q)]
    df = spark.createDataFrame(rows, "rec_no bigint, split string, id string, question string")
    args = (df, "rec_no", "split", "id", "question", names, "title")
    got = [(x.rec_a, x.rec_b) for x in overlap.cross_split_overlaps(*args).collect()]
    assert {x.rec: x.links for x in overlap.overlap_counts(*args).collect()} == {5: 4, 6: 3, 7: 1, 8: 3} == Counter(b for _, b in got)


def overlapping(spark, names, rows, wording=True):
    lines = [f"Who {w} the harbour in {y}?" for y in (1901, 1902, 1903) for w in ("founded", "drained", "opened")] if wording else []
    rows = [*((900 + i, "train", None, t) for i, t in enumerate(lines)), *((k, s, f"i{k}", t) for k, s, t in rows)]
    df = spark.createDataFrame(rows, "rec_no bigint, split string, id string, question string")
    return {(x.rec_a, x.rec_b) for x in overlap.cross_split_overlaps(df, "rec_no", "split", "id", "question", names, "title").collect()}


def test_overlaps_of_questions_with_fewer_than_two_names(spark, names):
    one, none = "Who founded Lake Gikoum?", "When was the ballot paper first counted by machine?"
    hits = [(200, one.replace("founded", "foundde")), (201, "Hey, could you tell me please: who founded Lake Gikoum"), (202, "who founded lake gikoum"), (203, "WHO FOUDED LAKE GIKOUM?")]
    hits0 = [(300, none.replace("ballot", "balot")), (301, "Please tell me, when was ballot paper first counted by machine?"), (302, none.lower())]
    miss = [(400, one.replace("founded", "drained")), (401, one.replace("Lake Gikoum", "Новкорпол")), (402, one.replace("Who", "When")), (403, none.replace("machine", "hand")), (404, one.replace("Gikoum", "Gikoun")), (405, "the"), (406, "Please?")]
    rows = [(101, "train", one), (102, "train", none), (103, "train", "a")]
    got = overlapping(spark, names, rows + [(k, "dev", t) for k, t in hits + hits0 + miss])
    assert got == {(101, k) for k, _ in hits} | {(102, k) for k, _ in hits0}


def test_overlaps_keep_the_keys_of_all_copies_of_a_form(spark, names):
    cased = "Did Tavo ratify the pact at Lake Gikoum and Kuva (film)?"
    rows = [(101, "train", cased), (102, "train", cased.lower()), (201, "dev", cased.lower().replace("at lake", "at the lake"))]
    assert overlapping(spark, names, rows) == {(101, 201), (102, 201)}

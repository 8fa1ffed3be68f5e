"""Whether a response declines to answer, or says that it can't tell, by dictionaries of ten languages and a rule over clauses."""

from __future__ import annotations

import re

#: By language, who declines (self), others who may be spoken of (they), negations and words of lack (no),
#: what is declined (tell), where an answer is looked for (source), and words of regret (sorry). A star stands for any ending.
DICTIONARY = {
    "en": {
        "self": "i me my we us",
        "they": "he she they him her them his their who nobody everyone",
        "no": "not no cannot cant wont nothing none unable impossible insufficient inadequate missing lacking lack* absent unclear unknown decline* refuse* rather without neither beyond hard",
        "tell": "answer* say tell* know* determin* establish* infer* identif* decid* choose guess* find found help* assist* provid* respond* repl* comment* discuss* confirm* verif* conclud* deduc* specif* enough sufficient information idea way clue evidence detail* guess sure certain comply disclose share recall remember see appropriate able clear fact hint* evident",
        "source": "passage* text* context* document* source* excerpt* article* material* question* paragraph* snippet* here",
        "has": "contain* mention* mentioned state* stated given include* cover* show* list* indicate* present available refer* describe* address* offer* name* say* said suppl* report* record*",
        "sorry": "sorry apolog* unfortunately regrettabl* regret* afraid alas sadly",
    },
    "de": {
        "self": "ich mir mich wir uns man",
        "they": "er sie ihm ihn ihr wer niemand",
        "no": "nicht kein* nichts unmöglich unklar unbekannt fehl* weder ohne ungenügend unzureichend lehne verweiger* ablehn* leider",
        "tell": "antwort* beantwort* sagen sage weiß weiss wissen bestimm* feststell* ermittel* find* helfen helfe entscheid* erkenn* schließen angabe* information* hinweis* genug ausreich* hervor entnehm* ableit* beurteil* einschätz* raten kenne auskunft sicher ahnung klar eindeutig",
        "source": "text* abschnitt* kontext* passage* dokument* quelle* auszug* artikel* frage* absatz* absätz*",
        "has": "enthalt* enthält erwähn* nennt nennen genannt sagt steht angegeben liefert bietet gibt vorhanden beschreib*",
        "sorry": "leider entschuldig* verzeih* bedauer* leid",
    },
    "fr": {
        "self": "je j moi me m nous on",
        "they": "il elle ils elles lui leur qui personne",
        "no": "pas ne n rien aucun* impossible insuffisan* inconnu* manqu* ni sans incapable refus* jamais guère",
        "tell": "répon* repon* dire dis sais savoir détermin* determin* trouver trouve aider aide indiquer précis* identifi* conclu* déduire connais* information* réponse* idée assez suffis* moyen certain* sûr* deviner établir",
        "source": "passage* texte* contexte* document* source* extrait* article* question*",
        "has": "contien* mentionn* dit disent indiqu* donn* précis* cit* parl* figur* permet* fourni* couvr*",
        "sorry": "désolé* malheureusement excus* regrett* pardon hélas navré*",
    },
    "es": {
        "self": "yo me mí nos no se lo",
        "they": "él ella ellos ellas le quien nadie",
        "no": "no nada ningun* ningún imposible insuficiente* desconoc* falta* ni sin incapaz niego rechaz* tampoco",
        "tell": "respond* respuesta* decir digo sé saber determin* encontr* ayud* indic* precis* identific* conclu* deduc* informaci* datos idea suficiente* adivin* puedo podemos podría pude seguro establec* conozco",
        "source": "pasaje* texto* contexto* documento* fuente* fragmento* artículo* pregunta*",
        "has": "contien* mencion* dice* indic* aparec* incluy* permit* hay ofrec* figura* cubr* consta*",
        "sorry": "siento lamentabl* lamento desgraciad* perdón perdona disculp* desafortunad*",
    },
    "ru": {
        "self": "я мне меня мы нам",
        "they": "он она они его её их ему кто никто",
        "no": "не нет ничего ни нельзя невозможно недостаточно неизвестно отсутств* без неясно отказыва* вынужден",
        "tell": "ответ* отвеч* зна* сказ* определ* найти нашел нашёл помо* указ* установ* вывод* информаци* данн* сведени* могу можем может уверен* угад* судить понят*",
        "source": "текст* отрыв* контекст* документ* источник* фрагмент* стать* вопрос* абзац*",
        "has": "содерж* упомин* говор* указ* сказан* описан* приведен* сообща* привод*",
        "sorry": "сожалени* извин* прост* увы",
    },
    "it": {
        "self": "io mi me noi ci non si",
        "they": "lui lei loro egli chi nessuno",
        "no": "non niente nulla nessun* impossibile insufficient* sconosciut* manca* né senza incapace rifiut* purtroppo",
        "tell": "rispond* rispost* dire dico so sapere determin* trov* aiut* indic* precis* identific* conclud* dedurre informazion* dati idea abbastanza sufficient* posso possiamo potrei conosco sicur* stabilir* indovin* grado",
        "source": "passaggi* testo testi contesto documento documenti fonte fonti brano brani estratt* articol* domanda",
        "has": "contien* contengono menzion* dice dicono indica* forni* riport* compare cita citano",
        "sorry": "spiace dispiace purtroppo scus* mi",
    },
    "pt": {
        "self": "eu me mim nós nos não se",
        "they": "ele ela eles elas lhe quem ninguém",
        "no": "não nada nenhum* impossível insuficiente* desconhec* falta* nem sem incapaz recus* infelizmente",
        "tell": "respond* resposta* dizer digo sei saber determin* encontr* ajud* indic* precis* identific* conclu* deduz* informaç* dados ideia suficiente* posso podemos poderia consigo conheço certeza estabelec* adivinh*",
        "source": "passagem passagens texto* contexto* documento* fonte* trecho* artigo* pergunta*",
        "has": "contém contêm mencion* diz dizem indic* aparec* inclu* permit* há oferec* consta* cita*",
        "sorry": "desculp* infelizmente lamento sinto perdão perdoe",
    },
    "nl": {
        "self": "ik mij me we wij ons men",
        "they": "hij zij ze hem haar hen wie niemand",
        "no": "niet geen niets onmogelijk onduidelijk onbekend ontbre* zonder onvoldoende weiger* noch helaas",
        "tell": "antwoord* beantwoord* zeggen zeg weet weten bepalen vaststell* vinden vind help* beslis* afleid* informatie gegevens aanwijzing* genoeg voldoende idee zeker raden kan kunnen ken opmaken beoordel* duidelijk",
        "source": "tekst* passage* context document* bron* fragment* artikel* vraag alinea*",
        "has": "bevat* vermeld* noem* zegt zeggen staat geeft geven beschrijf* biedt",
        "sorry": "sorry helaas spijt excus* jammer",
    },
    "pl": {
        "self": "ja mi mnie my nam nie",
        "they": "on ona oni jego jej ich kto nikt",
        "no": "nie nic brak brakuje żadn* niemożliw* niejasn* nieznan* bez odmawiam niestety",
        "tell": "odpowie* odpowied* powiedzie* wiem wiedzie* okreś* ustali* znale* pomóc wskaza* wywnioskow* informacj* danych wystarczając* mogę możemy można pewn* zgadywa* stwierdzi* znam jestem",
        "source": "tekst* fragment* kontek* dokument* źród* artykuł* pytani* akapit*",
        "has": "zawiera* wspomina* mówi* podaj* podan* opisuj* wymieni*",
        "sorry": "przykro przepraszam niestety żałuj*",
    },
    "sv": {
        "self": "jag mig vi oss man",
        "they": "han hon de honom henne dem vem ingen",
        "no": "inte ingen inget inga inte omöjligt oklart okänt saknas utan otillräcklig* vägrar avstår varken tyvärr",
        "tell": "svar* besvar* säga säger vet veta avgör* fastställ* hitt* hjälp* bestäm* information* uppgift* tillräcklig* nog aning säker kan gissa bedöma känner utläsa",
        "source": "text* passage* sammanhang* dokument* käll* utdrag* artik* fråga* stycke*",
        "has": "innehåll* nämn* säger står anger angiv* ger beskriv* framgår",
        "sorry": "tyvärr ledsen förlåt ursäkta beklag*",
    },
}
#: Endings and words of Japanese by which a response declines.
JAPANESE = re.compile("わかりません|分かりません|判断できません|判りません|答えられません|お答えできません|できません|申し訳|ありません|記載されていません|記載がありません|書かれていません|不明です|かねます|存じません|知りません")
#: Words that begin a sentence and name nothing.
OPENERS = frozenset("a an the there this that these those it its as after based given from with would could in on at for according answer das dies diese dieser dazu es die der den aus laut le la les l ce cette cela d il los las el un una esto eso este esta para в это этот эта из на по o os as isso este esta não il lo gli questo questa dal dai het de dit dat uit w z to ten ta det den den här av".split())
BUT = frozenset("but yet however still aber doch jedoch sondern mais pourtant pero sino aunque но однако ma però mas porém maar echter ale lecz jednak men utan".split())
CLAUSE = re.compile(r"[.!?;:,\n。！？…]+|\s[-–—]\s")
WORD = re.compile(r"[^\W\d_]+")
CONTRACTED = re.compile(r"\b(can|won|don|doesn|didn|isn|aren|wasn|weren|couldn|wouldn|hasn|haven)['’]?t\b", re.I)
KEYS = ("self", "they", "no", "tell", "source", "has", "sorry")


def _pattern(words: str) -> re.Pattern[str]:
    return re.compile("(?:" + "|".join(r"\w*".join(re.escape(x) for x in w.split("*")) for w in words.split()) + r")\Z")


PATTERNS = {lang: {k: _pattern(groups[k]) for k in KEYS} for lang, groups in DICTIONARY.items()}
_seen: dict[str, tuple[tuple[str, frozenset[str]], ...]] = {}


def _senses(word: str) -> tuple[tuple[str, frozenset[str]], ...]:
    """Languages in which the word is in the dictionary, with its groups there."""
    if word not in _seen:
        if len(_seen) > 100_000:
            _seen.clear()
        found = ((lang, frozenset(k for k, p in groups.items() if p.match(word))) for lang, groups in PATTERNS.items())
        _seen[word] = tuple((lang, f) for lang, f in found if f)
    return _seen[word]


#: Negations that are also pronouns or the like in their language: one of them alone is no speaker.
AMBIGUOUS = frozenset("no non não nie nos se lo si ci".split())
#: Pronouns of the speaker as the subject of a clause.
SUBJECT = frozenset("i ich je j я io eu ik ja jag yo me we wir nous мы noi nós wij my vi man".split())


def _declines(words: list[str], names: int, whole: bool) -> bool | None:
    """The rule, on one clause: words in lower case, and how many names and numbers it holds; None if only an impersonal clause says so.

    It declines if the speaker is denied telling or knowing; if a source is denied having something, beside each other, or
    without a name, or with the source or the denial in front; if telling is denied without anybody being spoken of; or if
    it only regrets.
    """
    impersonal = False
    places: dict[str, dict[str, list[int]]] = {}
    for i, w in enumerate(words):
        for lang, groups in _senses(w):
            for k in groups:
                places.setdefault(lang, {}).setdefault(k, []).append(i)
    for lang, at in places.items():
        if whole and at.get("sorry") and len(words) <= 2:
            return True
        no, source, has, they = (at.get(k, []) for k in ("no", "source", "has", "they"))
        tell = at.get("tell", [])
        if lang == "en":  # a determiner: no answer, no mention; else a verdict or a number
            no = [i for i in no if words[i] != "no" or any(i < j <= i + 2 for j in (*tell, *has))]
        tell = [i for i in tell if any(i != j for j in no)]  # a word that is both counts for one of them
        if not no:
            continue
        me = [i for i in at.get("self", []) if words[i] not in AMBIGUOUS and any(i != j for j in no)]
        if tell and me and not (they and they[0] < me[0]) and (not names or words[me[0]] in SUBJECT or me[0] <= no[0] + 5):
            return True
        if source and (has or tell or len(words) > 3):
            if any(0 < j - i <= 3 for i in no for j in source) or ((has or tell) and (not names or source[0] <= 3 and source[0] < no[-1] or no[0] <= 2)):
                return True
        impersonal = impersonal or bool(tell and not names and not they and 1 < len(words) <= 16)
    return None if impersonal else False


def declines(text: str) -> bool:
    """Whether some clause of the text declines."""
    if JAPANESE.search(text):
        return True
    text = CONTRACTED.sub(lambda m: m[1] + " not", text)
    parts = [p for p in CLAUSE.split(text) if p.strip()]
    cased = not text.isupper() and not text.islower()
    found: list[tuple[bool | None, bool]] = []  # of each clause: whether it declines, and whether it names something after a but
    for part in parts:
        raw = WORD.findall(part)
        # capitalised words that no dictionary has are names, but for those that open the text
        named = [bool(cased and w[0].isupper() and not _senses(w.casefold())) for w in raw]
        words = [w.casefold() for w in raw]
        if named and named[0] and part is parts[0] and words[0] in OPENERS:
            named[0] = False
        names = sum(named) + len(re.findall(r"\d+", part))
        found.append((_declines(words, names, len(parts) == 1), bool(names and words and words[0] in BUT)))
    return any(d or d is None and not any(after for _, after in found[i + 1 : i + 2]) for i, (d, _) in enumerate(found))

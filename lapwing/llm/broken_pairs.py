"""Broken prompt and response pairs (problem 3).

Ordered rules over one pair: emptiness, refusal phrases of several languages,
copied prompts, script and language mismatch, unclosed delimiters and abrupt
endings. Every rule that fires is emitted; ``first_defect`` keeps the first in
the order of :data:`ORDER`. All rules look at the whole texts of one row, so
the operator needs no shuffle and runs Arrow-batched.

Defined cases: a null or blank response is 'empty'; a null prompt gives no
'copy' and no 'language'; repeated deliveries of one id give one row per
defect; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import INVISIBLE

ORDER = ("empty", "refusal", "copy", "language", "truncated")

#: What stands for "no answer" after marks, tags and brackets are taken away.
PLACEHOLDERS = frozenset(
    "none null nil na nan n a blank empty undefined nooutput noanswer noresponse noreply nodata nocontent output response answer tbd tba todo "
    "placeholder insertanswerhere youranswerhere leer keine keineantwort vide aucune aucunereponse pasdereponse vacio ninguna sinrespuesta pending error".split()
)

#: Phrases that decline, matched within one sentence (lower case, plain apostrophes).
REFUSALS = re.compile(
    r"\b(?:"
    # English
    r"(?:i'?m|i am|we'?re|we are) (?:\w+ )?(?:sorry|afraid|unable)|(?:my|our) apologies|i (?:must |have to )?apologi[sz]e"
    r"|(?:i|we) (?:\w+ )?(?:can(?:no|')t|can not|could(?:n't| not)|won't|will not|would not|must not|may not) (?:\w+ )?(?:help|assist|answer|provide|write|list|discuss|comply|share|give|do|fulfil|fulfill|respond|reply|support|comment|continue|produce|offer|talk|engage|cover|address)"
    r"|(?:i|we) (?:am|are)(?: not|n't) (?:able|allowed|permitted|authori[sz]ed|in a position|comfortable)"
    r"|i'?m not (?:able|allowed|permitted|authori[sz]ed|in a position|comfortable)"
    r"|(?:must|have to|need to|going to) (?:decline|refuse|pass)|(?:i|we) (?:respectfully |politely )?(?:decline|refuse)|(?:would|'d) rather not|prefer not to"
    r"|(?:do|does) ?(?:not|n't) (?:feel comfortable|allow me|permit me|let me)|don't feel comfortable"
    r"|(?:request|question|topic|overview|answer)\b.{0,60} (?:cannot|can't|can not) be (?:fulfilled|given|answered|provided|met|processed|granted)"
    r"|no .{1,60} can be given by me|told to stay away|i have been (?:told|asked|instructed) (?:not )?to|leave (?:the|this|your) question unanswered"
    r"|(?:is|are) not (?:something|anything) i (?:do|can|will|may)|i must stop here|falls? outside (?:of )?what i|outside (?:of )?(?:what i|my)|not (?:a topic|something) i(?:'m| am| can)|goes against my|against my (?:guidelines|policy|rules)|beyond what i (?:can|am)"
    # German
    r"|(?:es )?tut mir (?:sehr )?leid|(?:kann|darf|möchte|will|werde) (?:\w+ ){0,6}(?:leider |lieber )?(?:nicht|keine?n?|nichts) (?:\w+ ){0,4}(?:helfen|antworten|beantworten|schreiben|sagen|geben|erteilen|nennen|liefern|weiterhelfen|äußern|eingehen)"
    r"|(?:leider )?(?:kann|darf) ich .{0,60}(?:nicht|nichts|keine)|(?:darf|kann) ich leider|fehlt (?:\w+ )?die erlaubnis|muss (?:ich )?(?:\w+ ){0,6}ablehnen|lehne (?:ich )?(?:\w+ ){0,5}ab|nicht gestattet|nicht erlaubt|ist mir untersagt|bitte um verständnis"
    # French
    r"|(?:je suis |nous sommes )?(?:vraiment |sincèrement )?désolée?|je regrette|(?:je|nous) ne (?:peux|peut|puis|pouvons|veux|souhaite|dois|suis)(?: vous| malheureusement)* (?:pas|en mesure|aider|répondre)|je ne (?:peux|puis|souhaite|suis) (?:\w+ ){0,4}pas|il ne m'est pas possible|(?:m'est|nous est) (?:interdit|impossible)|il m'est (?:interdit|impossible)"
    r"|préfère ne pas|(?:dois|devons|vais) (?:\w+ )?(?:décliner|refuser)|merci de votre compréhension|je refuse|ne me permettent pas|n'ai pas le droit|hors de (?:ma|mon|ce que je)|dépasse ce que je"
    # Spanish
    r"|lo (?:siento|lamento)(?: mucho)?|lamento (?:no|mucho)|no (?:me es posible|me está permitido|nos está permitido|puedo|podemos|estoy autorizad[oa]|tengo permitid[oa]|tengo permiso|quiero|deseo|voy a) ?(?:\w+ ){0,3}(?:ayudar\w*|responder\w*|hablar|escribir|dar\w*|ofrecer\w*|comentar|listar|proporcionar\w*|contestar|atender)?"
    r"|prefiero no|(?:debo|tengo que) (?:rechazar|declinar|negarme)|me temo que|queda fuera de lo que|fuera de (?:mi|lo que)|me está prohibido|no me permiten|rechazo"
    r")",
)

#: What often goes with a refusal and answers nothing.
CLOSERS = re.compile(
    r"\b(?:rephrase|reformul\w+|umformulier\w+|something else|something different|anything else|another (?:topic|question)|different, please|consult|specialist\w*|spécialiste\w*|especialista\w*|fachleute|fachperson|librarian|bibliothe?k\w*|biblioth[eé]ca\w*|bibliotecari\w*"
    r"|thank you|thanks for|danke|merci|gracias|verständnis|understanding|compréhension|comprensión|otra cosa|otro tema|autre chose|autre sujet|etwas anderes|andere frage|otra pregunta|perhaps|unfortunately|malheureusement|leider|lamentablemente|unanswered|assist\w*|no\.?$)"
)

#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in that for with are were but from by they is was what which how why please could would about have has been not on at this these their there its as be an did does do than some between since near each whether into first no yes most it or only while had we our you me your any where",
    "de": "der die das und in den von ist nicht mit eine einen einer eines zu des dem werden wurden wurde wird auf für im sich auch als es an bei nach aus um am sind war waren hat haben dass weshalb warum welche welcher wie über seit bitte zur zum durch noch nur rund einige mehr etwa kein keine zwischen vor",
    "fr": "le la les des et du en que une un pour dans sont ont pas sur de au aux qui par plus ce cette ces est avec se à selon entre où donne résume explique sait depuis été leur leurs ne on il elle après avant moins contrairement pourquoi sait-on",
    "es": "el la los las de y que en una un para por con se son no del al lo su sus más entre según cerca han fue fueron es como desde qué sobre sabe resume explica indica casos favor pero este esta estos estas hay muy todavía porque a",
    "it": "il lo la gli le di e che in una un per con si sono non del della dei delle dal al più tra fra come è da dopo nel nella sul sulla questo questa anche ma alcuni",
    "pt": "o a os as de e que em uma um para por com se são não do da dos das no na nos nas mais entre como é foi foram ao pelo pela sobre esta este também mas",
    "nl": "de het een en van in is niet met te dat die op voor zijn aan er om ook bij door naar uit over tot werd werden wordt maar deze dit geen tussen",
}
_FUNCTION = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}
_BY_WORD: dict[str, tuple[str, ...]] = {}
for _lang, _words in _FUNCTION.items():
    for _w in _words:
        _BY_WORD[_w] = (*_BY_WORD.get(_w, ()), _lang)

#: How a prompt names the language it wants.
ASKS_LANGUAGE = re.compile(
    r"\b(?:in|into|auf|ins|en|to|nach|al|vers l[e'’]|em|a[ul]) ?(?:the |plain |good |simple |einfachem |gutem )?(english|german|french|spanish|russian|italian|portuguese|dutch|latin|chinese|japanese|polish"
    r"|deutsch\w*|englisch\w*|französisch\w*|spanisch\w*|russisch\w*|italienisch\w*"
    r"|anglais|allemand|français|espagnol|russe|italien|inglés|alemán|francés|español|ruso|italiano)\b"
    r"|\b(?:translat\w+|übersetz\w+|tradui\w+|traduc\w+|traduz\w+)\b"
    r"|\b(english|german|french|spanish|russian|italian)(?:-language)? (?:sentences?|words?|text|version|summary|answer|paragraphs?|note|overview|abstract)\b"
    r"|\b(?:englische|deutsche|französische|spanische|russische)[nrsm]? (?:sätze|satz|antwort|fassung|übersetzung|zusammenfassung)\w*"
    r"|\b(?:phrases?|frases?|réponse|respuesta|résumé|resumen|texte|texto) (?:en )?(?:anglais\w*|allemand\w*|espagnol\w*|français\w*|ingles\w*|inglés|alem\w+|franc\w+|español\w*|rus\w+)\b",
    re.I,
)

_REFERENCES = re.compile(r"(?im)^[\s#*_>\-]*(?:references?|bibliograph(?:y|ie)|works cited|literature|literatur(?:verzeichnis)?|quellen(?:verzeichnis)?|références(?: bibliographiques)?|bibliografía|referencias|sources|fuentes|литература|источники)[\s:*_]*$")
_TAGS = re.compile(r"<[^<>]{0,40}>|\[/?[A-Z_]{2,12}\]")
_SENTENCE = re.compile(r"(?<=[.!?…。])[\"'”’»)\]]*\s+")
_ITEM = re.compile(r"^\s*(?:[-*•–]|\(?\d{1,3}[.)]|\(?[a-z][.)])(?:\s+|$)")
_END = re.compile(r"[.!?…。！？:;\"'”’»)\]}`*_|>]$")


_FAR_SCRIPT = re.compile("[\u0370-\uffff]")


@lru_cache(maxsize=64)
def _plain(text: str) -> str:
    if text.isascii():
        return text.casefold()
    return unicodedata.normalize("NFKC", text).replace("’", "'").replace("‘", "'").translate(dict.fromkeys(map(ord, INVISIBLE))).casefold()


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", _plain(text))


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    if len(re.findall(r"[^\W_]", _TAGS.sub(" ", text[:400]))) >= 24:
        return False  # no placeholder is that long, whatever follows
    bare = "".join(re.findall(r"[^\W_]+", unicodedata.normalize("NFD", _TAGS.sub(" ", _plain(text)))))
    bare = "".join(c for c in bare if c.isalnum())
    return not bare or len(bare) < 24 and bare in PLACEHOLDERS


def body(text: str) -> str:
    """The text before a closing bibliography."""
    found = _REFERENCES.search(text)
    return text[: found.start()] if found else text


def language(text: str) -> tuple[str | None, float]:
    """Language and the margin of its function words over the next language's, as a share of all words."""
    ws = re.findall(r"[^\W\d_]+(?:-on)?", text.lower())
    if not ws:
        return None, 0.0
    if not text.isascii() and _FAR_SCRIPT.search(text):
        letters = sum(map(len, ws))
        for lang, low, high in (("ru", 0x400, 0x530), ("el", 0x370, 0x400), ("he", 0x590, 0x600), ("ar", 0x600, 0x700), ("zh", 0x3040, 0xA000), ("ko", 0xAC00, 0xD7B0)):
            if sum(low <= ord(c) < high for w in ws for c in w) > 0.5 * letters:
                return lang, 1.0
    score = dict.fromkeys(_FUNCTION, 0.0)
    for w in ws:
        owners = _BY_WORD.get(w, ())
        for lang in owners:
            score[lang] += 1 / len(owners)
    low = text.lower()
    if not low.isascii():
        score["de"] += 0.5 * len(re.findall(r"[äöüß]", low)) * (not re.search(r"[éèçñ¿¡]", low))
        score["es"] += 2 * len(re.findall(r"[¿¡ñ]|ción\b", low))
        score["fr"] += 0.7 * len(re.findall(r"[èêçœù]", low))
    if "'" in low or "’" in low:
        score["fr"] += 0.7 * len(re.findall(r"\b(?:[ldnscjm]|qu)['’]\w", low))
    best, second = sorted(score, key=score.__getitem__)[:-3:-1]
    return best, (score[best] - score[second]) / len(ws)


def is_refusal(text: str) -> bool:
    plain = _plain(text).strip()
    parts = [s for s in _SENTENCE.split(plain) if re.search(r"\w", s)]
    declined, rest = 0, 0
    for s in parts:
        if REFUSALS.search(s):
            declined += 1
            # "I cannot confirm every page number, but the rest is well supported": it goes on with an answer
            if re.search(r"\b(?:but|however|aber|jedoch|mais|pero) (?:the rest|here|i can(?!'|not)|der rest|hier|le reste|voici|el resto|aquí)|(?:as follows|here is|voici|hier ist|a continuación)", s):
                rest += 40
        elif not CLOSERS.search(s):
            rest += len(s.split())
        if rest > 10:
            return False
    return declined > 0 and rest <= 10


def is_copy(prompt: str, text: str) -> bool:
    """True if nothing is left of the text once the prompt, its repeats and a lead-in of up to four words are taken out."""
    p = words(prompt)
    if len(p) < 3:
        return False
    # Whatever its length, a copy has six words at most that the prompt has not; its beginning mostly tells.
    own, start = set(p), words(text[:600])[:-1]
    if sum(w not in own for w in start) > 6:
        return False
    t = words(text)
    if not t:
        return False
    left = f" {' '.join(t)} "
    whole = f" {' '.join(p)} "
    hits = left.count(whole)
    if hits:
        rest = left
        while whole in rest:
            rest = rest.replace(whole, " ", 1)
        return len(rest.split()) <= 4
    # a prompt given back without its last or first word or two
    return len(t) >= max(3, len(p) - 2) and len(t) <= len(p) + 4 and f" {' '.join(p[: len(p) - 2])} " in left


def is_other_language(prompt: str, text: str) -> bool:
    if ASKS_LANGUAGE.search(prompt):
        return False
    main = body(text)
    if len(re.findall(r"[^\W_]+", main[:200])) < 4 and len(words(main)) < 4:
        return False
    want, sure = language(prompt)
    got, margin = language(main) if want is not None else (None, 0.0)
    if want is None or got is None or want == got:
        return False
    if got in ("ru", "el", "he", "ar", "zh", "ko") or want in ("ru", "el", "he", "ar", "zh", "ko"):
        return True
    return sure > 0.04 and margin > 0.06


_BRACKET = re.compile(r"[()\[\]{}]")


def unclosed(text: str) -> bool:
    """True if a bracket is opened and not closed."""
    opened = 0
    for c in _BRACKET.findall(text):
        opened = opened + 1 if c in "([{" else max(opened - 1, 0)
    return opened > 0


def is_truncated(text: str) -> bool:
    t = text if text.isascii() else text.translate(dict.fromkeys(map(ord, INVISIBLE)))
    t = t.rstrip()
    if not t:
        return False
    if t.count("```") % 2:
        return True
    found = _REFERENCES.search(t)
    if found and re.search(r"\w", t[found.end() :]):
        # a closing bibliography ends as its style has it, but not within brackets
        return unclosed(t[t.rfind("\n") + 1 :])
    if unclosed(t[max(t.rfind("\n\n"), 0) :]):
        return True
    lines = [x for x in t.split("\n") if x.strip()]
    last = lines[-1].strip()
    item = _ITEM.match(last)
    if item:
        content = last[item.end() :].strip()
        if not content:
            return True
        items = [x.strip() for x in lines[:-1] if _ITEM.match(x.strip())]
        if items and sum(bool(_END.search(x)) for x in items) * 2 <= len(items):
            return content.endswith((",", ";", ":")) or bool(re.search(r"\b(?:the|of|and|in|to|a|der|die|und|de|la|le|les|el|los|y|et)$", content.lower()))
        return not _END.search(last) or last.endswith((",", ";"))
    if _END.search(last) and not last.endswith((":", ";")):
        return False
    return True


def defects(prompt: str | None, text: str | None) -> list[str]:
    """All defect types of a pair, in the order of the rules."""
    if is_empty(text):
        return ["empty"]
    found = []
    if is_refusal(text):
        found.append("refusal")
    if prompt is not None and prompt.strip():
        if is_copy(prompt, text):
            found.append("copy")
        if is_other_language(prompt, text):
            found.append("language")
    if is_truncated(text):
        found.append("truncated")
    return found


def broken_pairs(df: DataFrame, id_col: str = "doc_id", prompt_col: str = "user_prompt", text_col: str = "generated_text") -> DataFrame:
    """(id, defects ARRAY<STRING>) of every defective pair, one row per id.

    Copies of a pair under one id give one row; should the texts under an id
    differ, the defects of all of them are united.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [defects(p, t) for p, t in zip(b["p"], b["t"], strict=True)]
            keep = [bool(x) for x in found]
            if any(keep):
                yield pd.DataFrame({"id": b["id"][keep].astype(object), "defects": [x for x in found if x]})

    pairs = df.select(F.col(id_col).alias("id"), F.col(prompt_col).alias("p"), F.col(text_col).alias("t"))
    id_type = dict(pairs.dtypes)["id"]
    flagged = pairs.mapInPandas(scan, f"id {id_type}, defects array<string>")
    return flagged.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("defects"))).alias("defects")).withColumnRenamed("id", id_col)


def first_defect(df: DataFrame) -> DataFrame:
    """The first defect of each pair in the order of the rules, in place of the array."""
    ranked = F.filter(F.array(*[F.lit(x) for x in ORDER]), lambda x: F.array_contains("defects", x))
    return df.withColumn("defect", F.try_element_at(ranked, F.lit(1))).drop("defects")

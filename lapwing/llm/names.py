"""Variant spellings of names typed by people (problem 1).

Distinct names are parsed into parts (given name, initials, surname; for
organisations their words). Misspelt parts are found by a pigeonhole segment
join: each part is cut into k+1 segments, of which at least one survives k
edits, so the position-shifted substrings of one part are looked up in an
inverted index of the segments of the others, and the candidates are verified
with a banded edit distance that counts a swap of neighbours as one edit. A
misspelling takes the form of its most widely used neighbour. Names then meet
only within one block - same surname and initial, or a shared telling word of an
organisation - where they are grouped by their parts in a pass that is linear
in the names of the block; pairs are written out within the resulting entities
only.

Defined cases: null and blank names are no names; names that differ in no byte
are one name; a name without a surname or word forms no link; an initial that
fits several given names of a surname goes to the one used most.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import components, visible, written

#: Words of organisations and their usual abbreviations.
ORG_WORDS = frozenset(
    "university hospital institute institut laboratory laboratories centre center society foundation network group observatory association college academy council department "
    "school agency consortium committee office ministry company corporation museum library commission bureau trust federation union board clinic faculty division programme program "
    "project collaboration team survey service services archive archives press initiative working study studies research records materials software historians evidence alliance panel "
    "forum authority registry unit club league workshop organisation organization universität universidad université istituto instituto hôpital klinik gesellschaft verein stiftung".split()
)
ORG_SHORT = frozenset("univ hosp inst lab labs cent ctr soc found fdn net netw grp obs assoc coll acad dept dep sch comm corp mus lib fed stud res rec softw work".split())
#: Words that join the words of an organisation's name.
LINKS = frozenset("the of for and on in at to de la le du des der die das für und et y e del van von".split())
#: Parts that come before a surname.
PARTICLES = frozenset("de del della da di du dos das van von der den ter ten zu zum zur el al la le bin ibn af av".split())
_TITLE = re.compile(r"^(?:(?:dr|prof|professor|mr|mrs|ms|miss|mx|sir|dame|rev|herr|frau|ing|pd|priv|doz|dott|mag|dipl)\b[.\s-]*)+(?=\S)", re.I)
_SUFFIX = re.compile(r"(?:[,\s]+(?:ph\.?\s?d\.?|m\.?d\.?|d\.?phil\.?|m\.?sc\.?|b\.?sc\.?|m\.?a\.?|esq\.?|jr\.?|sr\.?|ii|iii|iv)\.?)+$", re.I)
#: Short forms of given names.
NICKNAMES = {
    "alexander": "alex al sandy sasha xander lex", "alexandra": "alex sandy sasha lexi", "andrew": "andy drew", "anthony": "tony", "benedict": "ben benny dick", "benjamin": "ben benny",
    "catherine": "cathy kate katie cat", "charles": "charlie chuck", "christopher": "chris kit topher", "christine": "chris tina", "daniel": "dan danny", "david": "dave davy", "edward": "ed eddie ted teddy ned",
    "elizabeth": "liz beth betty eliza lizzie bess lisa libby elsie betsy", "frederick": "fred freddy freddie rick", "gabriele": "gabi gaby gabby", "gustav": "gus gusti", "james": "jim jimmy jamie", "john": "jack johnny jon",
    "joseph": "joe joey", "josephine": "jo josie josy fina", "katherine": "kate kathy katie kathie kit kay kat", "margaret": "maggie peggy meg margie marge greta peg", "matthew": "matt", "michael": "mike mick mickey micky",
    "nathaniel": "nat nate nathan", "nicholas": "nick nicky", "patricia": "pat trish patty patsy tricia", "peter": "pete", "philip": "phil", "rebecca": "becky", "richard": "rick dick rich richie", "robert": "bob rob robbie bobby bert robin",
    "rosalind": "rosie ros roz rosa", "samuel": "sam sammy", "stephen": "steve", "susanna": "sue susie suzy susan sanna", "theodora": "thea dora theo teddy", "thomas": "tom tommy", "victoria": "vicky tori vic vicki", "william": "bill will billy willy liam",
}
_FULL: dict[str, tuple[str, ...]] = {}
for _name, _short in NICKNAMES.items():
    for _s in _short.split():
        _FULL[_s] = (*_FULL.get(_s, ()), _name)


def fold(text: str) -> str:
    text = unicodedata.normalize("NFD", visible(text).casefold())
    return "".join(c for c in text if not unicodedata.combining(c))


def osa(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours), computed in a band of width most; most + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    # What both begin and end with costs nothing.
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return len(a) + len(b)
    if most == 1:
        return 1 if len(a) == len(b) == 1 or len(a) == len(b) == 2 and a == b[::-1] else 2
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            y = b[j - 1]
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], before[j - 2] + 1)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def parse(name: str) -> dict | None:
    """Parts of a name: kind ('person', 'org' or 'short', a word with capitals behind it), given, middle, surname, words."""
    text = re.sub(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ])", " ", re.sub(r"\bPh\.?\s?D\b", "phd", visible(name))).strip(" ,;.")
    text = re.sub(r"\s*\([^()]*\)", "", text) or text
    for _ in range(2):
        cut = _TITLE.sub("", _SUFFIX.sub("", text).strip(" ,;")).strip(" ,;")
        text = cut if len(cut.split()) > 1 else text  # "Name IV" has initials, not a numeral
    two = text.split()
    if len(two) == 2 and re.fullmatch(r"[A-ZÀ-Þ]{2,5}", two[1]) and not two[0].isupper() and two[0][-1] not in ".,;":
        return {"kind": "short", "given": fold(two[1])[0], "middle": fold(two[1])[1], "surname": re.sub(r"\W", "", fold(two[0])), "words": [fold(two[1])]}
    raw = [t for t in re.split(r"[\s,;/]+|(?<=\w)-(?=\w)", text) if t]
    bare = [fold(t).strip(".'’-") for t in raw]
    if not any(bare):
        return None
    of_org = [w in ORG_WORDS or w in ORG_SHORT or len(w) > 6 and any(w[0] == o[0] and osa(w, o, 1) <= 1 for o in ORG_WORDS) for w in bare]
    if any(of_org) and len(bare) > 1:
        small = not text.islower()  # a misspelt link word is still small
        words = [w for w, t in zip(bare, raw, strict=True) if w and w not in LINKS and not (small and len(w) <= 3 and t.islower())]
        return {"kind": "org", "given": "", "middle": "", "surname": "", "words": words}
    left, comma, right = text.partition(",")
    caps = ""
    if comma:
        surname, rest = left.split(), re.findall(r"[^\s.]+", right)
    else:
        tokens = text.split()
        if len(tokens) > 1 and re.fullmatch(r"[A-ZÀ-Þ]{1,3}", tokens[-1]) and not all(t.isupper() for t in tokens[:-1]):
            caps, surname, rest = tokens[-1], tokens[:-1], list(tokens[-1])
        else:
            parts = re.findall(r"[^\s.]+\.?", text)
            k = 1 if len(parts) > 1 else 0
            rest = [parts[0]] if k else []
            while k < len(parts) - 1 and (parts[k].endswith(".") or len(parts[k]) == 1):
                rest.append(parts[k])
                k += 1
            surname = parts[k:]
    own = [w for t in surname for w in re.split(r"[-\s]", fold(t)) if w]
    own = [w.strip(".'’") for w in own if w.strip(".'’") not in PARTICLES] or [w.strip(".'’") for w in own]
    given = [w for w in (fold(t).strip(".'’-") for t in rest) if w and w not in PARTICLES]
    if not own:
        return None
    return {"kind": "short" if len(caps) > 1 else "person", "given": given[0] if given else "", "middle": given[1][0] if len(given) > 1 else "", "surname": "".join(own), "words": [fold(caps)] if caps else []}


def parsed(names: DataFrame) -> DataFrame:
    """names(name, uses) with the parts of each name."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(n, u, p) for n, u, p in zip(b["name"], b["uses"], map(parse, b["name"]), strict=True) if p]
            if rows:
                yield pd.DataFrame({"name": [r[0] for r in rows], "uses": [r[1] for r in rows]} | {k: [r[2][k] for r in rows] for k in ("kind", "given", "middle", "surname", "words")})

    return names.mapInPandas(split, "name string, uses bigint, kind string, given string, middle string, surname string, words array<string>")


def segment_join(parts: DataFrame, long: int = 16) -> DataFrame:
    """(field, a, b) of all parts(field, part) of one field within k edits: k is 1, and 2 from `long` letters on."""
    k = f"IF(n < {long}, 1, 2)"
    # Segment i of a part of n letters cut into k + 1: the last n % (k + 1) are one letter longer.
    size = "(n div (k + 1) + IF(i >= k + 1 - n % (k + 1), 1, 0))"
    start = "(i * (n div (k + 1)) + greatest(0, i - (k + 1 - n % (k + 1))) + 1)"
    own = parts.select("field", "part", F.length("part").alias("m")).where("m >= 3")
    index = (
        own.withColumn("n", F.col("m"))
        .withColumn("k", F.expr(k))
        .select("field", "part", "n", "k", F.explode(F.expr("sequence(0, k)")).alias("i"))
        .select("field", F.col("part").alias("a"), "n", "i", F.expr(f"substring(part, {start}, {size})").alias("segment"))
    )
    at = own.select("field", "part", "m", F.explode(F.expr("sequence(greatest(3, m - 2), m)")).alias("n")).withColumn("k", F.expr(k)).where("m - n <= k")
    at = at.select("field", "part", "m", "n", "k", F.explode(F.expr("sequence(0, k)")).alias("i")).withColumns({"size": F.expr(size), "start": F.expr(start)})
    shifted = at.select("field", "part", "n", "i", F.explode(F.expr("transform(sequence(greatest(1, start - k), greatest(greatest(1, start - k), least(m - size + 1, start + k))), p -> substring(part, p, size))")).alias("segment"))
    # A swap across the border of the two segments spoils both: look up the first segment with the swap undone.
    crossed = at.where("m = n and k = 1 and i = 0 and m > size").select("field", "part", "n", "i", F.expr("concat(substring(part, 1, size - 1), substring(part, size + 1, 1))").alias("segment"))
    found = shifted.unionByName(crossed).distinct().join(index, ["field", "n", "i", "segment"]).where("a <> part").select("field", "a", F.col("part").alias("b")).distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = [osa(x, y, 2) <= (1 if min(len(x), len(y)) < long else 2) for x, y in zip(b["a"], b["b"], strict=True)]
            if any(keep):
                yield b[keep]

    close = found.where("levenshtein(a, b, 4) between 1 and 4").mapInPandas(verify, found.schema)
    return close.unionByName(close.select("field", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def spelling(parts: DataFrame, given_lead: float = 3.0, short: int = 6) -> DataFrame:
    """(field, part, spelt): the most widely used neighbour of each misspelt part; parts(field, part, df). Given names and parts of fewer than `short` letters give way only to a neighbour used given_lead times as much."""
    links = segment_join(parts.select("field", "part"))
    right = parts.select("field", F.col("part").alias("b"), F.col("df").alias("df_b"))
    scored = links.join(parts.select("field", F.col("part").alias("a"), F.col("df").alias("df_a")), ["field", "a"]).join(right, ["field", "b"])
    # A common given name is no misspelling of another common one, nor is a short surname, unless only two neighbours are swapped.
    swapped = (F.length("a") == F.length("b")) & (F.array_sort(F.split("a", "")) == F.array_sort(F.split("b", "")))
    guarded = (F.col("field") == "given") | (F.least(F.length("a"), F.length("b")) < short) & ~swapped
    better = scored.where(F.when(guarded, F.col("df_b") >= given_lead * F.col("df_a")).otherwise((F.col("df_b") > F.col("df_a")) | (F.col("df_b") == F.col("df_a")) & (F.col("b") < F.col("a"))))
    best = written(better.groupBy("field", F.col("a").alias("part")).agg(F.max_by("b", F.struct("df_b", F.col("b"))).alias("spelt")))
    onward = best.select("field", F.col("part").alias("spelt"), F.col("spelt").alias("next"))
    return best.join(onward, ["field", "spelt"], "left").select("field", "part", F.coalesce("next", "spelt").alias("spelt"))


def _abbreviates(a: str, b: str) -> bool:
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(a) < 2 or a[0] != b[0]:
        return len(a) > 3 and osa(a, b, 1) <= 1
    rest = iter(b)
    return all(c in rest for c in a) or len(a) > 4 and osa(a, b, 1) <= 1


def same_org(a: list[str], b: list[str]) -> bool:
    """Each word of one has its own word of the other that is the same, misspelt or shortened; a word may also be the initials of all words left."""
    if len(a) > len(b):
        a, b = b, a

    def rest(own: list[str]) -> list[str] | None:
        left = list(b)
        for w in sorted(own, key=len, reverse=True):
            hit = next((x for x in left if x == w), None) or next((x for x in left if _abbreviates(w, x)), None)
            if hit is None:
                return None
            left.remove(hit)
        return left

    if len(a) == len(b):
        return rest(a) == []
    for k, w in enumerate(a):
        if 2 <= len(w) <= 5 and (left := rest(a[:k] + a[k + 1 :])) and sorted(w) == sorted(x[0] for x in left):
            return True
    return False


def group_persons(rows: list[tuple[str, int, str, str, str]]) -> list[list[str]]:
    """Entities among (name, uses, given, spelt, middle) of one surname and initial; spelt differs from given if that is a misspelling."""
    full: dict[str, list[tuple[str, int, str]]] = defaultdict(list)
    short: list[tuple[str, int, str, str]] = []
    misspelt: dict[str, str] = {}
    for name, uses, given, spelt, middle in rows:
        if len(given) > 1:
            full[given].append((name, uses, middle))
            if spelt != given:
                misspelt[given] = spelt
        else:
            short.append((name, uses, given, middle))
    # A misspelling joins the form it is nearest to here, which need not be its most used neighbour elsewhere.
    for wrong in sorted(misspelt, key=lambda g: (len(full[g]), g)):
        near = [g for g in full if g != wrong and osa(g, wrong, 1) <= 1] or [g for g in full if g != wrong and misspelt.get(g) == misspelt[wrong]]
        if near:
            full[max(near, key=lambda g: (g not in misspelt, len(full[g]), g))] += full.pop(wrong)
        elif misspelt[wrong] in _FULL or misspelt[wrong] in NICKNAMES:
            full[misspelt[wrong]] += full.pop(wrong)
    # Short forms join the full name they stand for, if it occurs here.
    for nick in sorted(g for g in full if g in _FULL):
        there = [f for f in _FULL[nick] if f in full]
        if there:
            full[max(there, key=lambda f: (len(full[f]), f))] += full.pop(nick)
    entities: list[dict] = []
    for given in sorted(full):
        by: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for name, uses, middle in full[given]:
            by[middle].append((name, uses))
        middles = sorted((m for m in by if m), key=lambda m: (-len(by[m]), m))
        if len(middles) <= 1:
            entities.append({"middle": middles[0] if middles else "", "names": [x for v in by.values() for x in v]})
        else:
            for m in middles:
                entities.append({"middle": m, "names": list(by[m])})
            entities[-len(middles)]["names"] += by.get("", [])
    alone: dict[str, list[str]] = defaultdict(list)
    for name, uses, _, middle in sorted(short):
        fits = [e for e in entities if not middle or not e["middle"] or e["middle"] == middle]
        exact = [e for e in fits if middle and e["middle"] == middle] or fits
        if exact:
            max(exact, key=lambda e: (sum(u for _, u in e["names"]), e["names"][0]))["names"].append((name, uses))
        else:
            alone[middle].append(name)
    if "" in alone and len(alone) == 2:
        alone = {"": [x for v in alone.values() for x in v]}
    return [[n for n, _ in e["names"]] for e in entities] + list(alone.values())


def group_orgs(rows: list[tuple[str, list[str], str]]) -> list[list[str]]:
    """Entities among (name, words, core): core is set for a word followed by capitals, which words then hold."""
    by: dict[tuple, list[str]] = defaultdict(list)
    for name, words, core in rows:
        by[(core, *words) if core else ("", *sorted(words))].append(name)
    order = {("", *sorted(words)): words for _, words, core in sorted(rows, reverse=True) if not core}
    keys = sorted(by)
    head = {k: k for k in keys}

    def find(k: tuple) -> tuple:
        while head[k] != k:
            k = head[k]
        return k

    for x, a in enumerate(keys):
        for b in keys[:x]:
            if find(a) == find(b):
                continue
            if a[0] and b[0]:
                same = a == b
            elif a[0] or b[0]:
                short, whole = (a, b) if a[0] else (b, a)
                initials = "".join(w[0] for w in order[whole] if w != short[0])
                same = short[0] in whole and short[1] == initials
            else:
                same = same_org(list(a[1:]), list(b[1:]))
            if same:
                head[find(a)] = find(b)
    out: dict[tuple, list[str]] = defaultdict(list)
    for k in keys:
        out[find(k)] += by[k]
    return list(out.values())


def _blocks(names: DataFrame) -> DataFrame:
    """Names by the blocks in which they meet, with their parts."""
    parts = written(parsed(names))
    each = parts.select("name", F.explode(F.expr("filter(array(struct('given' AS field, given AS part, -1 AS at), struct('surname' AS field, surname AS part, -2 AS at)), x -> x.part <> '')")).alias("x")).unionByName(
        parts.where("kind = 'org'").select("name", F.posexplode("words").alias("at", "part")).select("name", F.struct(F.lit("surname").alias("field"), "part", "at").alias("x"))
    )
    each = each.select("name", "x.*")
    counted = written(each.groupBy("field", "part").agg(F.count_distinct("name").alias("df")))
    spelt = spelling(counted)
    fixed = each.join(spelt, ["field", "part"], "left").withColumn("part", F.coalesce("spelt", "part")).drop("spelt")
    counts = fixed.groupBy("field", "part").agg(F.count_distinct("name").alias("df"))
    told = fixed.join(counts, ["field", "part"]).groupBy("name").agg(
        F.max(F.when(F.col("at") == -1, F.col("part"))).alias("spelt"),
        F.max(F.when(F.col("at") == -2, F.col("part"))).alias("surname"),
        F.array_sort(F.collect_list(F.when(F.col("at") >= 0, F.struct("at", "part", "df")))).alias("words"),
    )
    whole = written(parts.select("name", "uses", "kind", "given", "middle", F.try_element_at(F.col("words"), F.lit(1)).alias("caps")).join(told, "name"))
    # Blocks: surname and initial of the full given name; for organisations their three most telling words.
    full = F.create_map(*[F.lit(x) for k, v in sorted(_FULL.items()) for x in (k, "".join(sorted({f[0] for f in v} | {k[0]})))])
    initials = F.concat(*[F.coalesce(F.try_element_at(full, F.col(c)), F.substring(c, 1, 1), F.lit("")) for c in ("given", "spelt")])
    persons = whole.where("kind <> 'org'").select(
        F.lit("person").alias("kind"), "name", "uses", "given", F.coalesce("spelt", "given").alias("spelt"), "middle", F.array().cast("array<string>").alias("words"), F.lit("").alias("core"),
        F.explode(F.array_distinct(F.split(F.when(initials == "", F.lit("-")).otherwise(initials), ""))).alias("initial"), F.col("surname").alias("block"),
    )
    usual = ", ".join(f"'{w}'" for w in sorted(ORG_WORDS) if w.isascii())
    rare = F.expr(f"slice(array_sort(transform(words, w -> struct(w.part IN ({usual}) AS usual, length(w.part) < 6 AS brief, w.df AS df, w.part AS part))), 1, 3)")
    orgs = whole.where("kind = 'org'").select("name", "uses", F.transform("words", lambda w: w["part"]).alias("words"), F.lit("").alias("core"), F.explode(rare).alias("rare"))
    orgs = orgs.select("name", "uses", "words", "core", F.col("rare.part").alias("block"))
    shorts = whole.where("kind = 'short'").select("name", "uses", F.array("caps").alias("words"), F.col("surname").alias("core"), F.col("surname").alias("block"))
    orgs = orgs.unionByName(shorts).select(F.lit("org").alias("kind"), "name", "uses", F.lit("").alias("given"), F.lit("").alias("spelt"), F.lit("").alias("middle"), "words", "core", F.lit("").alias("initial"), "block")

    return persons.unionByName(orgs)


def _groups(key: tuple, pdf: pd.DataFrame) -> list[list[str]]:
    """Entities of a block, the names of each in order."""
    if key[0] == "person":
        groups = group_persons(list(zip(pdf["name"], pdf["uses"], pdf["given"], pdf["spelt"], pdf["middle"], strict=True)))
    else:
        groups = group_orgs([(n, list(w), c) for n, w, c in zip(pdf["name"], pdf["words"], pdf["core"], strict=True)])
    return [sorted(set(g)) for g in groups]


def variants(names: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b, of all names(name, uses) of one person or organisation."""

    def pairs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = [(a, b) for g in _groups(key, pdf) for i, a in enumerate(g) for b in g[i + 1 :]]
        return pd.DataFrame({"name_a": [a for a, _ in found], "name_b": [b for _, b in found]}, dtype=object)

    return _blocks(names).groupBy("kind", "block", "initial").applyInPandas(pairs, "name_a string, name_b string").distinct()


def classes(names: DataFrame) -> DataFrame:
    """(name, entity) of all names(name, uses) with a variant: one row per name, entity is the smallest name that can be reached by links.

    Links leave a block as a star around its entity's first name, so their number
    is that of the names, however many spellings one entity has.
    """

    def star(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = [(g[0], n) for g in _groups(key, pdf) for n in g[1:]]
        return pd.DataFrame({"a": [a for a, _ in found], "b": [b for _, b in found]}, dtype=object)

    links = _blocks(names).groupBy("kind", "block", "initial").applyInPandas(star, "a string, b string")
    return components(links).select(F.col("v").alias("name"), F.col("root").alias("entity"))


def author_names(*tables: DataFrame, column: str = "authors") -> DataFrame:
    """(name, uses) of all author strings of some tables."""
    own = [t.select(F.explode(column).alias("name")) for t in tables]
    every = own[0]
    for t in own[1:]:
        every = every.unionByName(t)
    return every.where("trim(name) <> ''").groupBy("name").agg(F.count("*").alias("uses"))

"""Personal information in free text, by bootstrapped contextual extraction.

One pass over the texts mines *occurrences*: pieces with the general form of a name, e-mail address,
telephone number, identity number or street address, each with its lexical patterns - the words to its left,
those to its right, and its own shape. Digit groups of other forms are mined too, as counterexamples.

Spark then works on the graph of patterns and instances, in rounds. *Seeds* are pairs of known name parts and
forms that leave no doubt. Only shares decide, never counts, so the size of the corpus makes no difference:

* Numbers, e-mails, addresses: a pattern accepts if a lower confidence bound of the share of accepted ones
  among its instances and counterexamples is high enough.
* Names: every pattern of an instance - left and right context, each of its two parts, how its parts are
  written elsewhere - shifts the odds of being a name by what its other instances are, and an instance takes
  the mean over all its occurrences. So a pair of ordinary nouns in thousands of contexts isn't a name for
  standing now and then where names stand. Parts of found names are evidence in the next round.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinemill.session import cut, free_name

KINDS = ("name", "email", "phone", "id_number", "street_address")


@dataclass(frozen=True)
class Bootstrap:
    """``share``: of accepted instances from which a pattern of numbers, e-mails or addresses accepts, as a lower
    bound ``width`` standard deviations below the measured share; ``weight``: how many instances the prior counts
    for in a name's pattern; ``context``: share of names in a context, as such a bound, from which it makes names of
    unknown parts; ``known``: chance that a pair with a known part is a name, and
    that one with a word mostly written small is none; ``most``: the largest
    shift of the odds by one pattern; ``rounds``: of the graph."""

    share: float = 0.6
    width: float = 1.0
    weight: float = 2.0
    known: float = 0.9
    context: float = 0.75
    most: float = 4.0
    rounds: int = 4


# ---- mining -----------------------------------------------------------------------------------

# Words that belong to a name or come before it, and parts of addresses.
_PARTICLES = "van von de der den del della di da du dos la le ten ter zu zum y"
_TITLES = "mr mrs ms miss dr prof sir lady herr frau monsieur madame mme mlle m señor señora sr sra don doña"
_TITLE_SET = frozenset(_TITLES.split())
_EN_STREETS = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Court|Ct|Drive|Place|Square|Close|Way|Terrace|Crescent|Hill|Row"
_FR_STREETS = "rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours|route|passage|square"
_DE_STREETS = "straße|strasse|str\\.|weg|gasse|platz|allee|ufer|ring|damm|steig"
_ES_STREETS = "C/|Calle|Avda\\.|Avenida|Av\\.|Plaza|Pza\\.|Paseo|Camino|Ronda|Travesía|Carrera"
_EN_UNITS = "Flat|Apt\\.?|Apartment|Unit|Suite|Floor|Door|Room"
_UNITS = (
    "(?:Flat|Apt\\.?|Apartment|Unit|Suite|Floor|Door|appt?\\.?|appartement|bât\\.?|étage|porte|esc\\.?|Wohnung|Whg\\.?|Etage|Tür|piso|puerta|apto\\.?) ?[0-9]{1,4}[A-Za-z]?"
    "|[0-9]{1,2}(?:\\.[ºª]|er|e|ème)(?: étage| piso)?(?: (?:[A-Z]|izda\\.?|dcha\\.?))?(?![\\p{L}\\p{N}])|[0-9]{1,2}\\. (?:OG|Stock|Etage)"
)

_GAP = r"[^\S\n]{1,3}"
_CAP = r"\p{Lu}[\p{L}\p{M}'’]+"
_PART = rf"{_CAP}(?:-{_CAP})*"
_INITIAL = r"\p{Lu}\."
_PARTICLE = rf"(?i:{'|'.join(_PARTICLES.split())})"
_NAME = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}@_'’-])(?P<a>{_PART})(?P<comma>,)?(?:{_GAP}{_INITIAL}){{0,3}}(?:{_GAP}{_PARTICLE}){{0,3}}{_GAP}(?P<b>{_PART})(?(comma)(?:{_GAP}{_INITIAL}){{0,2}})(?![\p{{L}}\p{{N}}@_])"
)
_WORD = regex.compile(r"[\p{L}\p{M}'’]+|[0-9]+|[^\s\p{L}\p{N}]")

_W = r"\p{Lu}[\p{L}'’-]+"
_STREET = regex.compile(
    "|".join(
        [
            rf"(?P<en>(?:(?i:{_EN_UNITS}) ?[0-9]{{1,4}}[A-Za-z]?,\s{{1,3}})?[0-9]{{1,5}}[A-Za-z]?\s{{1,3}}(?:{_W}\s{{1,3}}){{1,4}}?(?i:{_EN_STREETS})(?![\p{{L}}\p{{N}}]))",
            rf"(?P<fr>[0-9]{{1,5}}(?:\s?(?i:bis|ter|quater|[a-d])(?!\p{{L}}))?,?\s{{1,3}}(?i:{_FR_STREETS})(?:\s{{1,3}}(?i:de la|de l['’]|des|de|du|d['’]|la|le|les))?\s{{0,3}}{_W})",
            rf"(?P<de>(?:(?:Am|An der|Im|In der|Zum|Zur|AM|IM|ZUM|ZUR)\s{{1,3}})?(?:\p{{Lu}}[\p{{L}}-]*?(?i:{_DE_STREETS})|{_W}\s{{1,3}}(?i:straße|strasse|platz|allee|weg|ring|ufer|damm))\s{{1,3}}[0-9]{{1,5}}(?:\s?[a-zA-Z](?![\p{{L}}\p{{N}}]))?(?![\p{{N}}]))",
            rf"(?P<es>(?i:{_ES_STREETS})(?:\s{{1,3}}(?i:de la|de los|de las|del|de|la|el))?\s{{0,3}}{_W},?\s{{1,3}}(?i:n\.º\s?|nº\s?|núm\.\s?)?[0-9]{{1,5}}(?![\p{{N}}]))",
        ]
    )
)
_TAIL = regex.compile(rf",\s{{1,3}}(?:{_UNITS})", regex.I)
_EMAIL = regex.compile(
    r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%][\p{L}\p{N}._%+-]*(?P<at>@|\s@\s|\s?[\[({](?i:at)[\])}]\s?)"
    r"[\p{L}\p{N}][\p{L}\p{N}-]*(?:(?:\.|\s?[\[({](?i:dot)[\])}]\s?|\s\.\s)[\p{L}\p{N}-]*[\p{L}][\p{L}\p{N}-]*)+"
)
_DIGITS = regex.compile(
    r"(?<![\p{L}\p{N}@_])(?<![.:/,-]\p{N}*)"
    r"(?:\+[0-9]{1,3}[ .\-/]?)?(?:\([0-9]{1,5}\)[ .\-/]?)?(?:[A-Z]{1,3}[ ]?)?[0-9]{1,8}(?:[ .\-/][0-9]{2,6}|[A-Z][0-9]{3,6})*(?:-?[A-Z](?!\p{L})|(?<=[A-Z]{2} [0-9 ]+) [A-Z](?!\p{L}))?"
    r"(?![\p{L}\p{N}@])(?![.:/,x-][0-9])"
)
#: Where the costly patterns can match at all: near an at-sign, a number, a long number.
_AT = regex.compile(r"@|[\[({](?i:at)[\])}]")
_NUMBER = re.compile(r"[0-9]+")
_LONG = regex.compile(r"[0-9][0-9A-Z ().\-/]{3,}")
_LETTERS = re.compile(r"[^\W\d_]+")
_SSN = regex.compile(r"[0-9]{3}([- ])[0-9]{2}\1[0-9]{4}")
_STREET_WORDS = frozenset(w for x in (_EN_STREETS, _FR_STREETS, _ES_STREETS) for w in x.lower().replace("\\.", "").replace("/", "").split("|"))
_STREET_ENDS = tuple(_DE_STREETS.replace("\\.", "").split("|"))
#: Words before and after its number (its sign) that the longest form of an address (an e-mail's name) takes.
_STREET_WORDS_AWAY, _EMAIL_WORDS_BEFORE = 8, 2
#: The most characters that can stand before a long number's first digit: +, three letters, a bracket, spaces.
_DIGIT_BEFORE = 8
_START = re.compile(r"(?:^|[.!?:…♪|>]['\"»”)]?\s+|\n\s*)([^\W\d_]+)")
_TOKEN = regex.compile(r"[^\p{L}@]*([\p{L}\p{M}'’]+?)(?:['’]s)?[^\p{L}\p{N}@_]*")


def _digit_kind(text: str) -> tuple[str, bool] | None:
    """(kind, seed) of a digit group; ``other`` for a counterexample; None if too small to matter."""
    digits = sum(c.isdigit() for c in text)
    letters = [c for c in text if c.isalpha()]
    if letters:
        return ("id_number" if 6 <= digits <= 12 else "other", False) if digits >= 5 else None
    if _SSN.fullmatch(text):
        return "id_number", True
    groups = _NUMBER.findall(text)
    if 9 <= digits <= 14 and len(groups) > 1:
        return "phone", text.startswith("+")
    return ("other", False) if digits >= 5 else None


def _shape(text: str) -> str:
    out = regex.sub(r"\p{Lu}", "A", regex.sub(r"\p{Ll}", "a", regex.sub(r"[0-9]", "9", text)))
    return regex.sub(r"\s+", " ", out)


def _context(text: str, start: int, end: int) -> tuple[str, str]:
    """The two tokens on either side within the sentence, in lower case with 9 for numbers; else ^ and $.

    Looks 80 characters back and 60 on; a token cut there is a token like any other.
    """
    line = max(text.rfind("\n", 0, start) + 1, start - 80)
    left = [t.lower() for t in _WORD.findall(text, line, start)]
    while left and left[-1] in _TITLE_SET:
        left.pop()
    ends = [i for i, t in enumerate(left) if t in ".!?♪"]
    left = ["^", "^", *left[ends[-1] + 1 if ends else 0 :]][-2:]
    stop = text.find("\n", end)
    stop = min(len(text) if stop < 0 else stop, end + 60)
    right = [t.lower() for t in _WORD.findall(text, end, stop)][:2]
    right = right[: next((i for i, t in enumerate(right) if t in ".!?♪"), 2)] + ["$", "$"]
    number = lambda t: "9" if t[0].isdigit() else t
    return " ".join(map(number, left)), " ".join(map(number, right[:2]))


def _words_back(flat: str, at: int, words: int) -> int:
    """The place ``words`` words before ``at``, the word at ``at`` not counted; ``flat`` has spaces for all white space."""
    for _ in range(words + 1):
        if (at := flat.rfind(" ", 0, at)) < 0:
            return 0
        while at and flat[at - 1] == " ":
            at -= 1
    return at


def _words_on(flat: str, at: int, words: int) -> int:
    for _ in range(words + 1):
        if (at := flat.find(" ", at)) < 0:
            return len(flat)
        while at < len(flat) and flat[at] == " ":
            at += 1
    return at


def _within(pattern, text: str, spans: Iterator[tuple[int, int]]):
    """The matches of ``pattern`` that begin in the spans (ascending), in order, each once and whole."""
    last = 0
    for start, stop in _merged(spans):
        for m in pattern.finditer(text, max(start, last), stop):
            # A match that the span's end may have cut is made again without it.
            m = (pattern.match(text, m.start()) or m) if m.end() >= stop - 2 else m
            if m.start() >= last:
                last = m.end()
                yield m


def _merged(spans: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    start = stop = -1
    for a, b in spans:
        if a <= stop:
            stop = max(stop, b)
        else:
            if stop >= 0:
                yield start, stop
            start, stop = a, b
    if stop >= 0:
        yield start, stop


def _has_street(text: str, a: int, b: int) -> bool:
    words = [w.lower() for w in _LETTERS.findall(text, a, b)]
    return any(w in _STREET_WORDS or w.endswith(_STREET_ENDS) for w in words)


def mine(text: str, words: Counter, starts: Counter) -> Iterator[tuple]:
    """(start, end, kind, shape, seed, left, right, first, second) of every occurrence.

    Counts the words as written, and those at the start of a sentence, of texts that aren't all in capitals.
    """
    tokens = text.split()
    big, little = sum(map(str.isupper, tokens)), sum(map(str.islower, tokens))
    if big <= 4 * little or big + little < 4:
        words.update(tokens)
        starts.update(_START.findall(text))
    flat = text
    for space in "\n\t\r\xa0\u2009\u202f":  # after rarer ones a word just counts as longer
        flat = flat.replace(space, " ")
    taken = bytearray(len(text))

    def take(a: int, b: int) -> None:
        taken[a:b] = b"\1" * (b - a)

    def free(a: int, b: int) -> bool:
        return not any(taken[a:b])

    found = []
    signs = ((_words_back(flat, m.start(), _EMAIL_WORDS_BEFORE), _words_on(flat, m.end(), 3)) for m in _AT.finditer(text))
    for m in _within(_EMAIL, text, signs):
        form = "plain" if m["at"] == "@" and not regex.search(r"[\[({\s]", m[0]) else "written out " + regex.sub(r"[\p{L}\p{N}]+", "a", m["at"].lower())
        found.append((m.start(), m.end(), "email", form, form == "plain"))
        take(*m.span())
    numbers = ((_words_back(flat, m.start(), _STREET_WORDS_AWAY), _words_on(flat, m.end(), _STREET_WORDS_AWAY)) for m in _NUMBER.finditer(text))
    for m in _within(_STREET, text, (s for s in _merged(numbers) if _has_street(text, *s))):
        a, b = m.span()
        if tail := _TAIL.match(text, b):
            b = tail.end()
        if free(a, b):
            form = m.lastgroup
            word = regex.search({"en": rf"({_EN_STREETS})$", "fr": f"({_FR_STREETS})", "de": f"({_DE_STREETS})", "es": f"({_ES_STREETS})"}[form], m[0], regex.I)
            found.append((a, b, "street_address", f"{form} {word[0].lower() if word else ''}", True))
            take(a, b)
    for m in _within(_DIGITS, text, ((max(0, m.start() - _DIGIT_BEFORE), m.end() + 2) for m in _LONG.finditer(text))):
        if free(*m.span()) and (what := _digit_kind(m[0])):
            found.append((*m.span(), what[0], _shape(m[0]), what[1]))
            if what[0] != "other":
                take(*m.span())
    for a, b, kind, shape, seed in found:
        left, right = _context(text, a, b)
        yield a, b, kind, shape, seed, left, right, None, None
    for m in _NAME.finditer(text, overlapped=True):
        first, second = m["a"].lower(), m["b"].lower()
        if first == second or first in _TITLE_SET or second in _TITLE_SET or not free(*m.span()):
            continue
        left, right = _context(text, *m.span())
        shape = "family, given" if m["comma"] else "given family"
        yield m.start(), m.end(), "name", shape, False, left, right, first.split("-")[0], second.split("-")[-1]


_MINED = (
    "hash long, start int, stop int, kind string, text string, shape string, seed boolean, left string, right string, first string,"
    " second string, small long, large long"
)


def occurrences(df: DataFrame, key: str, text: str) -> DataFrame:
    """What ``mine`` finds in every text, and rows of kind ``word`` with counts of small and capital writing.

    Capital writing counts away from the start of a sentence only. ``hash`` tells texts under one key apart.
    """
    schema = T.StructType([T.StructField("doc", df.schema[key].dataType), *T._parse_datatype_string(_MINED).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, starts = Counter(), Counter()

        def told() -> pd.DataFrame:
            counts: dict[str, list[int]] = {}
            for w, n in words.items():
                if m := _TOKEN.fullmatch(w):
                    w = m[1]
                    counts.setdefault(w.lower(), [0, 0])[0 if w[0].islower() else 1] += n
            for w, n in starts.items():
                if not w[0].islower() and (c := counts.get(w.lower())):
                    c[1] = max(0, c[1] - n)
            words.clear()
            starts.clear()
            return pd.DataFrame([(None, None, 0, 0, "word", w, None, False, None, None, None, None, *n) for w, n in counts.items()], columns=schema.names)

        for batch in batches:
            rows = []
            for k, h, t in zip(batch["k"], batch["h"], batch["x"]):
                for a, b, kind, shape, seed, left, right, first, second in mine(t, words, starts):
                    rows.append((k, h, a, b, kind, t[a:b], shape, seed, left, right, first, second, 0, 0))
            if rows:
                yield pd.DataFrame(rows, columns=schema.names)
            if len(words) > 300_000:
                yield told()
        if words:
            yield told()

    x = F.col(text).cast("string")
    source = df.select(F.col(key).alias("k"), x.alias("x"), F.xxhash64(x).alias("h")).filter("k is not null and length(x) > 0")
    return source.mapInPandas(run, schema)


# ---- the graph --------------------------------------------------------------------------------


def _accepted_numbers(rest: DataFrame, p: Bootstrap) -> DataFrame:
    """(kind, inst) of the accepted e-mails, numbers and addresses.

    A pattern's counterexamples are, in a context, instances of other kinds; a shape belongs to one kind.
    Instances that are neither accepted nor counterexamples don't count, so a pattern needn't wait until most
    of its instances are known. A context without any word or number is no pattern.
    """
    pattern = F.explode(F.array(F.concat(F.lit("L "), "left"), F.concat(F.lit("R "), "right"), F.concat(F.lit("S "), "shape"))).alias("pattern")
    edges = rest.select("kind", pattern, "inst", "seed").filter(F.col("pattern").rlike(r"^(S |..*[\p{L}\p{N}])"))
    edges = cut(edges.groupBy("kind", "pattern", "inst").agg(F.max("seed").alias("seed")))
    by_kind = edges.filter("pattern not like 'S %'").groupBy("kind", "pattern").count()
    every = by_kind.groupBy("pattern").agg(F.sum("count").alias("every"))
    against = cut(by_kind.join(every, "pattern").select("kind", "pattern", (F.col("every") - F.col("count")).alias("no")))
    wanted = edges.filter("kind <> 'other'")
    accepted = cut(edges.filter("seed").select("kind", "inst").distinct())
    for _ in range(p.rounds - 1):
        yes = edges.join(accepted, ["kind", "inst"], "left_semi").groupBy("kind", "pattern").agg(F.count("*").alias("yes"))
        n = F.col("yes") + F.coalesce("no", F.lit(0))
        good = yes.join(against, ["kind", "pattern"], "left").filter(lower_bound(F.col("yes") / n, n, p.width) >= p.share).select("kind", "pattern")
        accepted = cut(wanted.join(good, ["kind", "pattern"], "left_semi").select("kind", "inst").unionByName(accepted).distinct())
    return accepted


def lower_bound(share: Column, n: Column, width: float) -> Column:
    """The lower end of Wilson's interval for a share measured on ``n``."""
    z = width * width
    return (share + z / (2 * n) - width * F.sqrt(share * (1 - share) / n + z / (4 * n * n))) / (1 + z / n)


def _scored_names(windows: DataFrame, words: DataFrame, names: DataFrame, name: str, name_kind: str, p: Bootstrap) -> DataFrame:
    """(inst, score, seed) of the pairs that count as names; ``score`` is a logarithm of odds.

    A pair is a seed if its parts are known, one as given and one as family name. One with no known part
    begins as a counterexample, one with a known part counts from the second round on.
    """
    known = names.select(F.explode(F.split(F.lower(F.trim(F.col(name))), "[ -]+")).alias("part"), F.col(name_kind).alias("role")).filter("part <> ''")
    known = cut(known.groupBy("part").agg(F.max(F.col("role") == "given").alias("given"), F.max(F.col("role") == "family").alias("family")))
    share = F.col("small") / (F.col("small") + F.col("large"))
    case = words.groupBy(F.col("text").alias("part")).agg(F.sum("small").alias("small"), F.sum("large").alias("large"))
    case = case.select("part", F.when(F.col("small") + F.col("large") == 0, "?").when(share < 0.1, "C").when(share < 0.5, "m").otherwise("s").alias("case"))

    contexts = windows.groupBy("first", "second", "left", "right").agg(F.count("*").alias("n"))
    pairs = contexts.groupBy("first", "second").agg(F.sum("n").alias("times"))
    for side in ("first", "second"):
        pairs = pairs.join(known.select(F.col("part").alias(side), F.col("given").alias(f"{side}_g"), F.col("family").alias(f"{side}_f")), side, "left")
        pairs = pairs.join(case.select(F.col("part").alias(side), F.col("case").alias(f"{side}_c")), side, "left")
    is_known = lambda side: F.col(f"{side}_g").isNotNull()
    yes = lambda c: F.coalesce(c, F.lit(False))
    pairs = cut(
        pairs.select(
            F.concat_ws("|", "first", "second").alias("inst"),
            "first",
            "second",
            "times",
            yes((F.col("first_g") & F.col("second_f")) | (F.col("first_f") & F.col("second_g"))).alias("seed"),
            is_known("first").alias("known_first"),
            is_known("second").alias("known_second"),
            F.concat_ws("", F.coalesce("first_c", F.lit("?")), F.coalesce("second_c", F.lit("?"))).alias("case"),
        )
    )
    # Edges (inst, pattern, w): w is the part of the instance's occurrences that have the pattern.
    both = F.explode(F.array(F.concat(F.lit("L "), "left"), F.concat(F.lit("R "), "right"))).alias("pattern")
    around = contexts.select(F.concat_ws("|", "first", "second").alias("inst"), both, "n").groupBy("inst", "pattern").agg(F.sum("n").alias("n"))
    around = around.join(pairs.select("inst", "times"), "inst").select("inst", "pattern", (F.col("n") / F.col("times")).alias("w"), F.lit(False).alias("known"))
    part = F.explode(F.array(F.struct(F.col("first").alias("part"), F.col("known_first").alias("known")), F.struct(F.col("second").alias("part"), F.col("known_second").alias("known")))).alias("p")
    parts = pairs.select("inst", part).select("inst", F.concat(F.lit("P "), "p.part").alias("pattern"), F.lit(1.0).alias("w"), "p.known")
    written = pairs.select("inst", F.concat(F.lit("C "), "case").alias("pattern"), F.lit(1.0).alias("w"), F.lit(False).alias("known"))
    edges = cut(around.unionByName(parts).unionByName(written))

    one = F.col("known_first") | F.col("known_second")
    scored = pairs.select("inst", "seed", F.when(F.col("seed"), 1.0).when(~one, 0.0).alias("s"), F.lit(None).cast("double").alias("score"), F.lit(False).alias("part"))
    logit = lambda x: F.log(x / (1 - x))
    for _ in range(p.rounds):
        with_s = edges.join(scored.select("inst", "s"), "inst")
        stats = with_s.groupBy("pattern").agg(F.sum("s").alias("pos"), F.count("s").alias("n"))
        total = scored.agg(F.sum("s").alias("pos"), F.count("s").alias("n")).first()
        prior = ((total["pos"] or 0.0) + 1) / (total["n"] + 2)
        start = math.log(prior / (1 - prior))
        # What the other instances of a pattern say: its own part of the sums is taken out.
        pos, n = F.greatest(F.col("pos") - F.coalesce("s", F.lit(0.0)), F.lit(0.0)), F.col("n") - F.col("s").isNotNull().cast("int")
        chance = (pos + p.weight * prior) / (n + p.weight)
        chance = F.when(F.col("known"), F.greatest(chance, F.lit(p.known))).when(F.col("pattern").rlike("^C .*s"), F.least(chance, F.lit(1 - p.known))).otherwise(chance)
        shift = F.greatest(F.least(logit(chance) - start, F.lit(p.most)), F.lit(-p.most))
        # A name needs more than odds: a part that is known or mostly stands in names; or a context that mostly holds
        # names, and no part that mostly stands elsewhere.
        is_part, some = F.col("pattern").startswith("P "), F.greatest(n, F.lit(1))
        name_part = is_part & (F.col("known") | (pos * 2 > n))
        other_part = is_part & ~F.col("known") & (n > 0) & (pos * 2 < n)
        strong = F.col("pattern").rlike("^[LR] ") & (lower_bound(pos / some, some, p.width) >= p.context)
        seen = with_s.join(stats, "pattern").select("inst", (F.col("w") * shift).alias("shift"), *[c.alias(a) for c, a in ((name_part, "a"), (other_part, "b"), (strong, "c"))])
        sums = seen.groupBy("inst").agg((F.sum("shift") + start).alias("score"), (F.max("a") | (F.max("c") & ~F.max("b"))).alias("part"))
        new = sums.join(pairs.select("inst", "seed"), "inst")
        scored = cut(new.select("inst", "seed", F.when(F.col("seed"), 1.0).when(F.col("part"), 1 / (1 + F.exp(-F.col("score")))).otherwise(0.0).alias("s"), "score", "part"))
    return scored.filter("seed or (part and score > 0)").select("inst", "score", "seed")


def find_personal(df: DataFrame, key: str, text: str, names: DataFrame, name: str, name_kind: str, params: Bootstrap | None = None, *, with_hash: bool = False) -> DataFrame:
    """``doc, start, stop, kind, text``: every piece of personal data, by place (characters, from 0).

    ``names`` holds known name parts; ``name_kind`` is ``given`` or ``family``. Pieces of one text don't
    overlap. NULL and empty texts and NULL keys give nothing; texts under one key count as they come, each by
    itself (``with_hash`` adds ``hash``, the text's xxhash64, to tell them apart). Other columns are ignored.
    Without known parts no names are found, the other kinds still are.
    """
    p = params or Bootstrap()
    mined = cut(occurrences(df, key, text))
    rest = mined.filter("kind not in ('word', 'name')").withColumn("inst", F.lower("text"))
    place = ["doc", "hash", "start", "stop", "kind", "text"]
    numbers = rest.filter("kind <> 'other'").join(_accepted_numbers(rest, p), ["kind", "inst"], "left_semi").select(*place, F.lit(1e6).alias("sure"))
    windows = mined.filter("kind = 'name'").withColumn("inst", F.concat_ws("|", "first", "second"))
    people = _scored_names(windows, mined.filter("kind = 'word'"), names, name, name_kind, p)
    people = windows.drop("seed").join(people, "inst").select(*place, F.when(F.col("seed"), 1e3 + F.col("score")).otherwise(F.col("score")).alias("sure"))
    out = apart(numbers.unionByName(people))
    taken = [key]
    columns = [F.col(c).alias(free_name(c, taken)) for c in ("start", "stop", "kind", "text")]
    return out.select(F.col("doc").alias(key), *columns, *([F.col("hash").alias(free_name("hash", taken))] if with_hash else []))


def apart(rows: DataFrame) -> DataFrame:
    """Of overlapping pieces the surest stays, then the earliest, then the longest; what overlaps it goes.

    Only pieces that overlap another are gathered, by runs of overlapping ones; a run lies in one text.
    """
    rows = rows.distinct()
    before = Window.partitionBy("doc", "hash").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    until = Window.partitionBy("doc", "hash").orderBy("start", "stop", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("fresh", (F.col("start") >= F.coalesce(F.max("stop").over(before), F.lit(0))).cast("int"))
    rows = rows.withColumn("run", F.sum("fresh").over(until)).drop("fresh")
    rows = rows.withColumn("in_run", F.count("*").over(Window.partitionBy("doc", "hash", "run")))
    schema = rows.schema

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(_long=group["stop"] - group["start"]).sort_values(["sure", "start", "_long", "kind"], ascending=[False, True, False, True])
        kept: list[tuple[int, int]] = []
        flags = []
        for a, b in zip(group["start"], group["stop"]):
            flags.append(all(b <= c or a >= d for c, d in kept))
            if flags[-1]:
                kept.append((a, b))
        return group[flags][schema.names]

    return rows.filter("in_run = 1").unionByName(rows.filter("in_run > 1").groupBy("doc", "hash", "run").applyInPandas(pick, schema)).drop("run", "in_run")


def redact(df: DataFrame, key: str, text: str, found: DataFrame, kind: str = "kind", *, text_hash: str | None = None) -> DataFrame:
    """``df`` with every found piece of ``text`` replaced by its kind in brackets, like [EMAIL].

    ``text_hash``: a column of ``found`` with the text's xxhash64, needed if a key may stand for several texts.
    """
    by = [F.col(key).alias("_key"), *([F.col(text_hash).alias("_hash")] if text_hash else [])]
    spans = found.groupBy(*by).agg(F.array_sort(F.collect_set(F.struct("start", "stop", F.upper(kind).alias("kind")))).alias("_spans"))
    t = F.col(text)
    done = F.aggregate(
        "_spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(F.concat(acc["out"], t.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["stop"].alias("at")),
        lambda acc: F.concat(acc["out"], t.substr(acc["at"] + 1, F.length(t))),
    )
    same = F.col(key) == F.col("_key")
    if text_hash:
        same &= F.xxhash64(t.cast("string")) == F.col("_hash")
    return df.join(spans, same, "left").withColumn(text, F.when(F.col("_spans").isNotNull(), done).otherwise(t)).drop("_key", "_hash", "_spans")

"""Text expressions: everything here is a Column built from Spark's own functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bound

# Patterns by which a response is cut out of JSON or from under its headings.
QUOTED_RESPONSE = r'(?s)"distilled_response"\s*:\s*"([^"]+(?:\\.[^"]*)*)"'
BARE_RESPONSE = r'(?s)"distilled_response"\s*:\s*([^,}]+)'
HEADINGS = r"(?i)\*\*Distilled Response\*\*\s*|\*\*Reasoning\*\*\s*|Distilled Response\s*|Reasoning\s*"
BOLD_SECTION, PLAIN_SECTION = r"(?si)\*\*{heading}\*\*\s*(.+?)(?:\n\n|\*\*|$)", r"(?si){heading}\s*(.+?)(?:\n\n|\*\*|$)"

# Word lists of the heuristic filters and cleaners.
ACTION_VERBS = ("analyze", "assess", "calibrate", "compare", "culture", "evaluate", "incubate", "measure", "mix", "prepare", "run", "simulate", "synthesize", "test", "validate")
MEASURABLE = (
    "concentration", "expression", "ph", "growth", "lactate", "conductivity", "strength", "fluorescence", "atp", "cell count",
    "temperature", "pressure", "voltage", "current", "resistance", "absorbance", "optical density", "viability", "proliferation",
    "apoptosis", "metabolism", "enzyme activity", "kinetic", "rate", "yield", "efficiency", "density", "mass", "volume",
)
ACTIONABLE = (
    "increase", "decrease", "inhibit", "knockdown", "heat", "cool", "apply", "measure", "quantify", "assay", "incubate", "simulate",
    "treat", "culture", "expose", "administer", "inject", "add", "remove", "extract", "purify", "analyze", "detect", "monitor",
    "record", "evaluate", "assess", "determine",
)
FLUFF = (
    "in conclusion", "overall", "this highlights", "based on the above", "it is important to note", "furthermore", "additionally",
    "moreover", "therefore", "thus", "hence", "consequently", "in summary", "to summarize", "as a result", "in essence", "in other words",
)
UNSAFE = (
    "weapon", "pathogen enhancement", "bsl-3", "bsl-4", "biosafety level 3", "biosafety level 4", "environmental release", "gene drive",
    "dual use", "gain of function", "crpr on humans", "human germline", "embryo editing",
)
KNOWN_FACTS = ("is known", "has been shown", "studies indicate", "it is well established")
TESTABLE = ("will", "should", "would", "predict", "hypothesis", "if", "then")
METHOD_GROUPS = (
    ("culture", "cell", "organism", "sample", "specimen", "material"),
    ("treat", "inhibit", "knockdown", "add", "apply", "expose", "heat", "cool"),
    ("control", "untreated", "baseline", "reference"),
    ("measure", "assay", "detect", "quantify", "analyze", "spectroscopy", "fluorescence"),
    ("bsl", "safety", "disposal", "protective", "gloves", "fume hood"),
)
CITATION = r"(?i)(\[[0-9]{1,3}\]|\(ref\)|doi:\S+|arxiv:\d+)"
PROMPT_CLASSES = (
    ("units", (r"\bconvert\b", r"\bunit[s]?\b", r"\bkelvin\b", r"\bpascal\b", r"\bmol\b", r"\b%c\b")),
    ("literature", (r"\bdoi\b", r"\bcite\b", r"\breference\b", r"\bliterature\b", r"\bpaper\b", r"\bstudy\b")),
    ("simulation", (r"\bsimulat(e|ion)\b", r"\brun\b.*\bpython\b", r"\bmodel\b", r"\bcalculate\b", r"\bcompute\b", r"\bplot\b")),
    ("hybrid", (r"\bbattery\b", r"\bporosity\b", r"\bdiffusion\b", r"\bkinetic[s]?\b", r"\btemperature\b", r"\bc-rate\b", r"\bcurrent density\b")),
)


def squeezed(text: Column) -> Column:
    """White space of any kind, as runs, becomes one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def any_of(words: tuple[str, ...]) -> str:
    """A pattern that is found where one of the words is. Where no word begins the pattern fails on one look at the character, and words share
    what they begin with, so that the time does not grow with their number. A word that goes on after another is left out, for the shorter one is found."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def branch(node: dict) -> str:
        if "" in node:
            return ""
        parts = [re.escape(c) + branch(n) for c, n in node.items()]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return branch(tree) if "" in tree else f"(?=[{''.join(map(re.escape, tree))}]){branch(tree)}"


def contains_any(text: Column, words) -> Column:
    """Whether the lower-cased text has one of the words as a substring. Null has none."""
    if not words:
        return F.lit(False)
    return F.lower(F.coalesce(text, F.lit(""))).rlike(any_of(tuple(words)))


def has_word(text: Column, words) -> Column:
    return F.lower(squeezed(F.coalesce(text, F.lit("")))).rlike(r"(?U)\b(" + "|".join(words) + r")\b")


def has_citation(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(CITATION)


def token_estimate(text: Column) -> Column:
    """0 for empty text, else a quarter of the characters, rounded up."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n / 4))).cast("long")


def word_count(text: Column) -> Column:
    words = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\r\x0B\f]+"))
    return words.cast("long")


def chunks(text: Column, size: int, stride: int) -> Column:
    """An array of (start, chunk): starts run to the end of the text, so the last ones can be parts of the one before."""
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(size)).alias("chunk")))


def sentences(text: Column) -> Column:
    """Parts after ., ! or ? and white space, trimmed, without empty ones."""
    parts = F.split(F.trim(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def ended(text: Column) -> Column:
    return bound(text, lambda t: F.when((t != "") & ~t.rlike(r"[.!?]$"), F.concat(t, F.lit("."))).otherwise(t))


def first_sentences(text: Column, n: int = 3) -> Column:
    """The first n sentences, if there are more; else the trimmed text."""
    cut = lambda parts: F.regexp_replace(F.array_join(F.slice(parts, 1, n), " "), r"\s*\.\.\.\s*$", "")
    return bound(sentences(text), lambda parts: F.when(F.size(parts) > n, ended(cut(parts))).otherwise(F.trim(F.coalesce(text, F.lit("")))))


def distilled_response(text: Column) -> Column:
    """The quoted JSON value, else the bare one, else the text without the headings."""
    t = F.trim(F.coalesce(text, F.lit("")))
    quoted = F.regexp_extract(t, QUOTED_RESPONSE, 1)
    quoted = F.trim(F.replace(F.replace(F.replace(quoted, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\\/"), F.lit("/")))
    bare = F.btrim(F.trim(F.regexp_extract(t, BARE_RESPONSE, 1)), F.lit('"'))
    plain = F.trim(F.regexp_replace(t, HEADINGS, ""))
    return F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(bare, F.lit("")), plain)


def section(text: Column, heading: str = "Distilled Response") -> Column:
    """The section under a bold heading, else under a plain one, else the whole text."""
    t = F.coalesce(text, F.lit(""))
    bold = F.trim(F.regexp_extract(t, BOLD_SECTION.replace("{heading}", heading), 1))
    plain = F.trim(F.regexp_extract(t, PLAIN_SECTION.replace("{heading}", heading), 1))
    return F.coalesce(F.nullif(bold, F.lit("")), F.nullif(plain, F.lit("")), F.trim(t))


def hypothesis(text: Column, n: int = 3) -> Column:
    """At most n sentences that make a testable claim; without enough of them the first acceptable ones."""
    clean = F.filter(sentences(distilled_response(text)), lambda s: ~contains_any(s, FLUFF) & (contains_any(s, MEASURABLE) | contains_any(s, ACTIONABLE)) & ~contains_any(s, KNOWN_FACTS))

    def best(c: Column) -> Column:
        testable = F.filter(F.slice(c, 1, 2 * n), lambda s: contains_any(s, TESTABLE) | (contains_any(s, MEASURABLE) & contains_any(s, ACTIONABLE)))
        return bound(testable, lambda t: F.when(F.size(t) >= n, F.slice(t, 1, n)).otherwise(F.slice(c, 1, n)))

    return F.trim(ended(F.array_join(bound(clean, best), " ")))


def methodology(text: Column, n: int = 6, least: int = 4) -> Column:
    """The n lines of the highest score, in the order of score and place, filled up to `least` from the other lines."""

    def lines_of(t: Column) -> Column:
        lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
        return bound(lines, lambda ls: F.when(F.size(ls) == 1, sentences(t)).otherwise(ls))

    def score(line: Column) -> Column:
        total = F.when(contains_any(line, ACTIONABLE), 1).otherwise(0)
        for group in METHOD_GROUPS:
            total = total + F.when(contains_any(line, group), 2).otherwise(0)
        return total

    def chosen(lines: Column) -> Column:
        scored = F.transform(lines, lambda x, i: F.struct((-score(x)).alias("s"), i.alias("i"), x.alias("line"), contains_any(x, FLUFF).alias("fluff")))
        best = F.transform(F.slice(F.sort_array(F.filter(scored, lambda x: (x["s"] < 0) & ~x["fluff"])), 1, n), lambda x: x["line"])
        rest = lambda b: F.filter(lines, lambda x: ~F.array_contains(b, x))
        filled = lambda b: F.concat(b, F.slice(rest(b), 1, F.greatest(F.lit(0), F.lit(least) - F.size(b))))
        return bound(best, lambda b: F.when((F.size(b) < least) & (F.size(lines) >= least), filled(b)).otherwise(b))

    return F.trim(F.array_join(bound(bound(distilled_response(text), lines_of), chosen), "\n"))


def cut_at_sentence(text: Column, limit: int = 600) -> Column:
    """Text over the limit is cut before the sentence that would cross it."""

    def cut(t: Column) -> Column:
        sums = lambda parts: F.transform(parts, lambda x, i: F.struct(x.alias("p"), i.alias("i")))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit(False).alias("full"))

        def add(acc: Column, p: Column) -> Column:
            longer = acc["n"] + F.length(p["p"]) + 1
            fits = ~acc["full"] & (longer <= limit)
            return F.struct(F.when(fits, longer).otherwise(acc["n"]).alias("n"), F.when(fits, p["i"] + 1).otherwise(acc["k"]).alias("k"), (~fits).alias("full"))

        parts = F.split(t, r"(?<=[.!?])\s+")
        short = bound(parts, lambda ps: F.array_join(F.slice(ps, 1, F.aggregate(sums(ps), start, add)["k"]), " "))
        return F.when(F.length(t) > limit, ended(short)).otherwise(t)

    return bound(text, cut)


def prompt_class(text: Column) -> Column:
    """The first class, in a fixed order, one of whose patterns is found in the lower-cased text; hybrid if none is."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), None
    for name, patterns in PROMPT_CLASSES:
        hit = low.rlike("(?U)" + "|".join(f"(?:{p})" for p in patterns))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("hybrid")


def looks_like_json(text: Column) -> Column:
    """Whether the text carries the known keys or braces, and then a quoted response or an object that parses."""
    t = F.trim(F.coalesce(text, F.lit("")))
    marked = t.contains('"instruction"') | t.contains('"distilled_response"') | t.contains('"evidence_trace"') | (t.startswith("{") & t.endswith("}"))
    body = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return marked & (t.rlike(r'(?s)"distilled_response"\s*:\s*"([^"]+)"') | ((body != "") & F.try_parse_json(body).isNotNull()))


def human_size(n: Column, units: tuple[str, ...] = ("B", "KB", "MB", "GB", "TB")) -> Column:
    """Bytes with one decimal, in the largest of the units that is not above them; beyond the last one in that."""
    out = None
    for power, unit in enumerate(units):
        text = F.format_string(f"%.1f {unit}", F.bround(n.cast("double") / float(1024**power), 1))
        below = n < 1024 ** (power + 1) if power < len(units) - 1 else F.lit(True)
        out = F.when(below, text) if out is None else out.when(below, text)
    return out


def next_patch(version: Column) -> Column:
    """The version with its patch number raised; 1.0.0 where there is none."""
    p = F.split(version, r"\.")
    return F.when(version.rlike(r"^\d+\.\d+\.\d+$"), F.concat_ws(".", p[0], p[1], (p[2].cast("int") + 1).cast("string"))).otherwise("1.0.0")


def hash_mod(text: Column, modulus: int = 10_000) -> Column:
    """The SHA-256 of a text, as a number, modulo a small number: Horner's rule over groups of four hex digits."""
    digest = F.sha2(text, 256)
    groups = F.transform(F.sequence(F.lit(1), F.lit(61), F.lit(4)), lambda i: F.conv(F.substring(digest, i, F.lit(4)), 16, 10).cast("long"))
    return F.aggregate(groups, F.lit(0).cast("long"), lambda acc, g: (acc * 65536 + g) % modulus)

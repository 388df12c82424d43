"""Tool dialogues: numbers and units in answers, conversion requests, synthetic results, repairs, reports and episodes."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dialogs as D

# Units as (dimension, factor to the base unit), patterns, and the text that is put into reports.
UNITS = {
    "m": ("length", 1.0), "cm": ("length", 0.01), "mm": ("length", 0.001), "km": ("length", 1000.0),
    "g": ("mass", 0.001), "kg": ("mass", 1.0), "mg": ("mass", 1e-6),
    "s": ("time", 1.0), "min": ("time", 60.0), "hour": ("time", 3600.0),
    "mol": ("amount", 1.0), "mmol": ("amount", 0.001),
    "pascal": ("pressure", 1.0), "kilopascal": ("pressure", 1000.0), "bar": ("pressure", 100_000.0),
    "joule": ("energy", 1.0), "kilojoule": ("energy", 1000.0),
}
NUMBER = r"[-+]?\d*\.?\d+"
REQUEST = r"(?i)convert\s+([-+]?\d*\.?\d+)\s*([A-Za-z/%^0-9\-\s]+?)\s+to\s+([A-Za-z/%^0-9\-\s]+)"
LIMITATION = "Controller inserted limitation: verify citation(s) {ids} with papers.fetch."
CATEGORIES = ("units", "literature", "simulation", "hybrid")
REPAIRS = ("malformed_json", "missing_fetch", "python_error")


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), 0), lambda x: x.cast("double"))


def sane_numbers(stdout: Column, bound: float = -1e3) -> Column:
    """Whether all numbers of an output lie above the bound; an output that is null is not sane, one without numbers is."""
    return F.when(stdout.isNull(), False).otherwise(F.forall(numbers(stdout), lambda x: x > bound))


def close(a: Column, b: Column, relative: float = 1e-3, absolute: float = 1e-3) -> Column:
    return F.coalesce(F.abs(a - b) <= F.greatest(relative * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute)), F.lit(False))


def converted(value: Column, source: Column, target: Column) -> Column:
    """A quantity in another unit of its dimension; null for unknown units and other dimensions."""
    size = F.create_map(*[F.lit(x) for u, (_, f) in UNITS.items() for x in (u, f)])
    kind = F.create_map(*[F.lit(x) for u, (k, _) in UNITS.items() for x in (u, k)])
    same = F.try_element_at(kind, source) == F.try_element_at(kind, target)
    return F.when(same, value * F.try_element_at(size, source) / F.try_element_at(size, target))


def conversion_request(prompt: Column) -> Column:
    """(value, from_unit, to_unit) asked for in a prompt; one mol to mmol where nothing is."""
    parts = [F.btrim(F.regexp_extract(prompt, REQUEST, i), F.lit(" \t\n\r")) for i in (1, 2, 3)]
    asked = F.coalesce(prompt, F.lit("")).rlike(REQUEST)
    values = (parts[0].try_cast("double"), parts[1], parts[2])
    return F.struct(*[F.when(asked, v).otherwise(F.lit(default)).alias(n) for v, n, default in zip(values, ("value", "from_unit", "to_unit"), (1.0, "mol", "mmol"))])


def pretty_block(tag: str, fields: dict[str, Column]) -> Column:
    """A fenced block with a JSON object of two-space indent; the fields are JSON texts."""
    lines = F.concat_ws(",\n", *[F.concat(F.lit(f'  "{n}": '), v) for n, v in fields.items()])
    return D.wrapped(tag, F.concat(F.lit("{\n"), lines, F.lit("\n}")))


def synthetic_works(prompt: Column, n: int) -> Column:
    """n made-up works, by the prompt's SHA-256: title, year, doi, url."""
    digest = F.sha2(prompt, 256)

    def one(i: Column) -> Column:
        mark = F.substring(digest, i * 8 + 1, F.lit(8))
        title = F.concat(F.lit(WORK_TITLE), F.initcap(F.substring(prompt, 1, 40)), F.lit(" ("), (i + 1).cast("string"), F.lit(")"))
        return F.struct(title.alias("title"), (2015 + i % 8).alias("year"), F.concat(F.lit(WORK_DOI), mark).alias("doi"), F.concat(F.lit(WORK_URL), mark).alias("url"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one)


def synthetic_latency(seed: Column) -> Column:
    """20 to 139 milliseconds by the first four hex digits of a seed."""
    return (20 + F.conv(F.substring(seed, 1, 4), 16, 10).cast("long") % 120).cast("int")


def truncated(flag: Column | None, raw: Column) -> Column:
    """Whether an answer was cut at its length: by its own flag, or by the first choice's finish reason in the raw response."""
    nested = F.coalesce(F.get_json_object(raw, "$.choices[0].finish_reason") == "length", F.lit(False))
    return nested if flag is None else F.coalesce(flag, F.lit(False)) | nested


# The marks of rendered chats, and the forms of made-up works.
USER_MARK, ASSISTANT_MARK = "<|user|>\n", "\n<|assistant|>\n"
WORK_TITLE, WORK_DOI, WORK_URL = "Study on ", "10.1234/", "https://example.org/"


def chat_text(prompt: Column, response: Column) -> Column:
    return F.concat(F.lit(USER_MARK), F.coalesce(prompt, F.lit("")), F.lit(ASSISTANT_MARK), F.coalesce(response, F.lit("")))


def cut(tokens: Column, most: int) -> Column:
    return F.slice(tokens, 1, most)


def scholarly_item(item: Column) -> Column:
    """A work's record from a registry's JSON: first title, authors by given and family name, the first whole number of the date."""
    j = F.from_json(item, "title array<string>, author array<struct<given:string,family:string>>, issued struct<`date-parts`:array<array<string>>>, DOI string, URL string, abstract string")
    names = F.transform(F.coalesce(j["author"], F.array().cast("array<struct<given:string,family:string>>")), lambda a: F.concat_ws(" ", F.nullif(F.trim(a["given"]), F.lit("")), F.nullif(F.trim(a["family"]), F.lit(""))))
    years = F.filter(F.transform(F.get(j["issued"]["date-parts"], 0), lambda y: y.try_cast("int")), lambda y: y.isNotNull())
    return F.struct(F.coalesce(F.get(j["title"], 0), F.lit("")).alias("title"), F.filter(names, lambda n: n != "").alias("authors"), F.get(years, 0).alias("year"), j["DOI"].alias("doi"), j["URL"].alias("url"), j["abstract"].alias("abstract"), F.lit("crossref").alias("source"))


def repaired(payload: Column) -> Column:
    """A tool call that is JSON, or a Python literal made into JSON; null where it is neither. Python reads only what is no JSON."""

    def literal(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return json.dumps(ast.literal_eval(t), ensure_ascii=False)
            except (SyntaxError, ValueError, TypeError, MemoryError, RecursionError):
                return None

        return texts.map(one, na_action="ignore")

    fixed = F.pandas_udf(literal, "string")(F.when(F.try_parse_json(payload).isNull(), payload))
    return F.when(F.try_parse_json(payload).isNotNull(), payload).otherwise(fixed)


def completed_report(report: Column, fetched: Column) -> Column:
    """(cited, unfetched, limitations) of a final report: cited works that were never fetched add a limitation."""
    j = F.from_json(report, "evidence array<struct<doi:string>>, limitations array<string>")
    none = F.array().cast("array<string>")
    cited = F.array_distinct(F.filter(F.coalesce(j["evidence"]["doi"], none), lambda x: x.isNotNull() & (x != "")))
    missing = F.sort_array(F.array_except(cited, F.coalesce(fetched, none)))
    quoted = F.concat(F.lit("["), F.array_join(F.transform(missing, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    note = F.replace(F.lit(LIMITATION), F.lit("{ids}"), quoted)
    limits = F.coalesce(j["limitations"], none)
    return F.struct(F.sort_array(cited).alias("cited"), missing.alias("unfetched"), F.when(F.size(missing) > 0, F.concat(limits, F.array(note))).otherwise(limits).alias("limitations"))


def episodes(prompts: DataFrame, key: str, prompt: str, category: str) -> DataFrame:
    """A row per prompt with its episode: messages (role, content) of a call, its result and a report, by category, and the repair scenario
    that the key's remainder by three names."""
    p, k, digest = F.col(prompt), F.col(key), F.sha2(F.col(prompt), 256)
    ask = conversion_request(p)
    ident = F.concat(F.lit('"call-'), F.substring(digest, 1, 8), F.lit('"'))
    args = (
        F.when(F.col(category) == "units", F.concat(F.lit('{"value": '), ask["value"].cast("string"), F.lit(', "from_unit": "'), ask["from_unit"], F.lit('", "to_unit": "'), ask["to_unit"], F.lit('"}')))
        .when(F.col(category) == "literature", F.concat(F.lit('{"doi": "10.1234/'), F.substring(digest, 1, 8), F.lit('"}')))
        .otherwise(F.lit('{"code": "print(1)"}'))
    )
    tool = F.when(F.col(category) == "units", '"units.convert"').when(F.col(category) == "literature", '"papers.fetch"').otherwise('"python.run"')
    call = pretty_block("toolcall", {"id": ident, "tool": tool, "args": args, "return_format": F.lit('"json"')})
    result = pretty_block("toolresult", {"id": ident, "ok": F.lit("true"), "meta": F.concat(F.lit('{"ms": '), synthetic_latency(digest).cast("string"), F.lit("}"))})
    final = pretty_block("final", {"evidence": F.when(F.col(category) == "literature", F.concat(F.lit('[{"doi": "10.1234/'), F.substring(digest, 1, 8), F.lit('"}]'))).otherwise("[]")})
    turns = [("user", p), ("assistant", call), ("tool", result), ("assistant", final)]
    messages = F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in turns])
    scenario = F.element_at(F.array(*map(F.lit, REPAIRS)), (F.pmod(k, F.lit(3)) + 1).cast("int"))
    return prompts.select(key, category, messages.alias("messages"), scenario.alias("repair"))

"""Tool episodes for training: dialogues that go from a question through calls and results to a report, and such that fail first and recover.

An episode is a walk through states: asked, called, answered, failed, warned, reported. Each step of a scenario goes from one state to the next and
adds one message; a scenario whose steps do not fit together is refused when it is declared, not found in the data. Scenarios are column
expressions over the prompt's row. Ids and latencies follow from the key and the step's name, results and works from the prompt.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dialogs as D
from . import tools as T

CATEGORIES = T.CATEGORIES
# The repair scenarios in turn, their prompts, messages and times, and the texts of reports.
REPAIRS = T.REPAIRS
REPAIR_PROMPTS = (
    "Summarise recent advances in binder-free cathodes.",
    "Provide a literature-backed argument for higher porosity cathodes at 5C.",
    "Estimate diffusion-limited capacity of LFP at 5C and 298K.",
)
BAD_JSON = "Invalid JSON payload: Expecting property name enclosed in double quotes."
NOT_FETCHED = "DOI cited in final response without successful papers.fetch."
TYPE_ERROR, NUM_ERROR = "TypeError during execution.", "TypeError: 'num' must be an integer"
BUGGY_CODE = "import numpy as np\nprint(np.linspace(0, 10, num='fast'))"
PREMATURE = '{"task": "premature_final", "note": "(omitted)"}'
NOTES = "Prioritise literature grounding before quantitative modelling."
GOAL = "Outline best tool sequence for the task."
MOST_WORKS = 3
REPAIR_MS = {"bad_json": 12, "fixed_json": 45, "search": 62, "warning": 5, "fetch": 31, "bad_python": 18}
#: Where each kind of step may come from, where it leads, and who speaks.
STEPS = {
    "ask": ({None}, "asked", "user"),
    "call": ({"asked", "answered", "failed", "warned"}, "called", "assistant"),
    "result": ({"called"}, "answered", "tool"),
    "error": ({"called"}, "failed", "tool"),
    "premature": ({"answered"}, "claimed", "assistant"),
    "warning": ({"claimed"}, "warned", "tool"),
    "report": ({"answered"}, "reported", "assistant"),
}


def quoted(text: Column) -> Column:
    """A text as JSON."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def obj(**fields: Column | str | int | float) -> Column:
    """A JSON object of JSON texts; plain values are written as JSON."""
    parts = []
    for name, value in fields.items():
        parts += [F.lit(f"{', ' if parts else ''}{json.dumps(name)}: "), value if isinstance(value, Column) else F.lit(json.dumps(value))]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def walked(steps: list[tuple[str, Column]]) -> Column:
    """The messages of a scenario."""
    state, out = None, []
    for kind, text in steps:
        sources, target, role = STEPS[kind]
        if state not in sources:
            raise ValueError(f"{kind} can't follow on {state}")
        state = target
        out.append(F.struct(F.lit(role).alias("role"), text.alias("content")))
    if state != "reported":
        raise ValueError(f"an episode can't end {state}")
    return F.array(*out)


class Scene:
    """What the steps of one row's episodes are made of."""

    def __init__(self, kind: str, key: Column, prompt: Column, works: Column | None = None, capacity: Column | None = None):
        """works, capacity: columns of what is made from the prompt, where that is no fixed text; an expression would be computed again for each use."""
        self.kind, self.key, self.prompt, self.known, self.printed = kind, key.cast("string"), prompt, works, capacity

    def ident(self, step: str) -> Column:
        return F.md5(F.concat(F.lit(f"{self.kind}:"), self.key, F.lit(f":{step}")))

    def call(self, step: str, tool: str, args: Column) -> tuple[str, Column]:
        return "call", T.pretty_block("toolcall", {"id": quoted(self.ident(step)), "tool": F.lit(f'"{tool}"'), "args": args, "return_format": F.lit('"json"')})

    def result(self, step: str, data: Column, ms: int | None = None) -> tuple[str, Column]:
        return "result", self.answer(step, "true", data, F.lit("null"), ms)

    def error(self, step: str, message: str, ms: int, data: Column | None = None) -> tuple[str, Column]:
        return "error", self.answer(step, "false", F.lit("null") if data is None else data, obj(message=message), ms)

    def answer(self, step: str, ok: str, data: Column, error: Column, ms: int | None) -> Column:
        took = T.synthetic_latency(self.ident(step)).cast("string") if ms is None else F.lit(str(ms))
        return T.pretty_block("toolresult", {"id": quoted(self.ident(step)), "ok": F.lit(ok), "data": data, "error": error, "meta": F.concat(F.lit('{"ms": '), took, F.lit("}"))})

    def report(self, task: str, evidence: Column | None = None, metrics: Column | None = None, limitations: tuple[str, ...] = ()) -> tuple[str, Column]:
        none = F.lit("[]")
        fields = {"task": F.lit(json.dumps(task)), "inputs": obj(prompt=quoted(self.prompt)), "metrics": none if metrics is None else F.concat(F.lit("["), metrics, F.lit("]")), "evidence": none if evidence is None else F.concat(F.lit("["), evidence, F.lit("]")), "limitations": F.lit(json.dumps(list(limitations)))}
        return "report", T.pretty_block("final", fields)

    def works(self, n: int) -> Column:
        return T.synthetic_works(self.prompt, n) if self.known is None else F.slice(self.known, 1, n)

    def search(self, n: int, step: str = "search", ms: int | None = None) -> list[tuple[str, Column]]:
        args = obj(query=quoted(self.prompt), top_k=n, corpus="crossref")
        return [self.call(step, "papers.search", args), self.result(step, obj(results=F.to_json(self.works(n))), ms)]

    def fetch(self, n: int, ms: int | None = None) -> list[tuple[str, Column]]:
        work = self.works(n)[0]
        return [self.call("fetch", "papers.fetch", obj(doi=quoted(work["doi"]))), self.result("fetch", F.to_json(F.struct(work["doi"].alias("doi"), work["title"].alias("title"), work["year"].alias("year"))), ms)]

    def evidence(self, n: int, use: str) -> Column:
        work = self.works(n)[0]
        return obj(doi=quoted(work["doi"]), title=quoted(work["title"]), where_used=use)

    def capacity(self) -> Column:
        """The number that the simulation prints: less the higher the first number of the prompt."""
        if self.printed is not None:
            return self.printed
        rate = F.coalesce(F.get(T.numbers(self.prompt), 0), F.lit(1.0))
        return F.round(165 * F.exp(-F.least(F.abs(rate), F.lit(50.0)) / 120), 2)

    def python(self, step: str, seconds: int) -> list[tuple[str, Column]]:
        shown = F.format_string("%.2f", self.capacity())
        code = F.concat(F.lit("capacity = "), shown, F.lit("\nprint(f'capacity={capacity:.2f}')"))
        out = obj(stdout=quoted(F.concat(F.lit("capacity="), shown, F.lit("\n"))), stderr="", artifacts=F.lit("[]"))
        return [self.call(step, "python.run", obj(code=quoted(code), timeout_s=seconds)), self.result(step, out)]

    def measured(self, name: str) -> Column:
        return obj(name=name, value=F.format_string("%.2f", self.capacity()), unit="mAh/g")


def built(prompts: DataFrame, key: str, prompt: str, category: str) -> DataFrame:
    """key, category, messages: an episode per prompt; unknown categories are hybrid. A hybrid one thinks first where the MD5 of the prompt says so."""
    made = Scene("episode", F.col(key), F.col(prompt))
    rows = prompts.select(key, prompt, category, made.works(MOST_WORKS).alias("_works"), made.capacity().alias("_capacity"), T.conversion_request(F.col(prompt)).alias("_ask"))
    s = Scene("episode", F.col(key), F.col(prompt), F.col("_works"), F.col("_capacity"))
    asked = ("ask", F.col(prompt))
    ask = F.col("_ask")
    rows = rows.withColumn("_value", F.coalesce(T.converted(ask["value"], ask["from_unit"], ask["to_unit"]), ask["value"]).cast("string"))
    value = F.col("_value")
    args = obj(value=ask["value"].cast("string"), from_unit=quoted(ask["from_unit"]), to_unit=quoted(ask["to_unit"]))
    units = [s.call("units", "units.convert", args), s.result("units", obj(value=value, unit=quoted(ask["to_unit"])))]
    think = [s.call("think", "think", obj(budget_tokens=256, goal=GOAL)), s.result("think", obj(notes=NOTES, budget_tokens=256))]
    study = [*s.search(3), *s.fetch(3)]
    mixed = [*study, *s.python("python", 12), s.report("hybrid_analysis", s.evidence(3, "Assumption for active material performance."), s.measured("simulated_capacity_mAh_g"), ("Simplified diffusion assumptions and no thermal coupling.",))]
    scenes = {
        "units": walked([asked, *units, s.report("unit_conversion", metrics=obj(name="converted_value", value=value, unit=quoted(ask["to_unit"])))]),
        "literature": walked([asked, *study, s.report("literature_grounding", s.evidence(3, "supports background section"), limitations=("Search limited to Crossref synthetic results.",))]),
        "simulation": walked([asked, *s.python("python", 10), s.report("python_simulation", metrics=s.measured("simulated_capacity_mAh_g"), limitations=("Model assumes linear scaling and ignores side reactions.",))]),
    }
    thinks = F.conv(F.substring(F.md5(F.col(prompt)), 1, 2), 16, 10).cast("int") % 5 == 0
    messages = F.when(thinks, walked([asked, *think, *mixed])).otherwise(walked([asked, *mixed]))
    for name, scene in scenes.items():
        messages = F.when(F.col(category) == name, scene).otherwise(messages)
    return rows.select(key, category, messages.alias("messages"))


def repairs(rows: DataFrame, key: str) -> DataFrame:
    """key, repair, messages: the scenarios in turn by the key. A malformed call is made again as JSON; a report that cites what was never fetched
    is sent back, fetches and reports; code that fails is mended and run."""
    scenes = [Scene("repair", F.col(key), F.lit(p)) for p in REPAIR_PROMPTS]
    asks = [("ask", F.lit(p)) for p in REPAIR_PROMPTS]
    s = scenes[0]
    broken = ("call", F.concat(F.lit("~~~toolcall\n{ 'id': '"), s.ident("json"), F.lit("', 'tool': 'papers.search' }\n~~~")))
    json_ = walked([asks[0], broken, s.error("json", BAD_JSON, REPAIR_MS["bad_json"]), *s.search(3, "json", REPAIR_MS["fixed_json"]), s.report("repair_malformed_json", limitations=("Initial request failed due to formatting error.",))])
    s = scenes[1]
    early = [("premature", D.wrapped("final", F.lit(PREMATURE))), ("warning", s.error("warning", NOT_FETCHED, REPAIR_MS["warning"])[1])]
    fetch = walked([asks[1], *s.search(2, ms=REPAIR_MS["search"]), *early, *s.fetch(2, REPAIR_MS["fetch"]), s.report("repair_missing_fetch", s.evidence(2, "Supports porosity-performance claim."), limitations=("Initial attempt lacked DOI verification.",))])
    s = scenes[2]
    failed = [s.call("buggy", "python.run", obj(code=BUGGY_CODE, timeout_s=10)), s.error("buggy", TYPE_ERROR, REPAIR_MS["bad_python"], obj(stdout="", stderr=NUM_ERROR, artifacts=F.lit("[]")))]
    python = walked([asks[2], *failed, *s.python("fixed", 10), s.report("repair_python_error", metrics=s.measured("diffusion_limited_capacity"), limitations=("Simplified kinetic representation.",))])
    turn = F.pmod(F.col(key), F.lit(3))
    messages = F.when(turn == 0, json_).when(turn == 1, fetch).otherwise(python)
    return rows.select(key, F.element_at(F.array(*map(F.lit, REPAIRS)), (turn + 1).cast("int")).alias("repair"), messages.alias("messages"))

"""Qualified-fact programs: a DAG of functions over entities, attributes and relations.

Tables: entities(entity_id, name), concepts(concept_id, name, parent_id), entity_concepts(entity_id, concept_id),
attr_facts(fact_id, entity_id, key, vtype, vstr, vnum, unit, qualifiers map<string,string>),
rel_facts(fact_id, subject, predicate, object, qualifiers map<string,string>).

A step gives a set (entity_id, fact_id, kind) or an answer. Where the published behaviour leaves a choice, ours is: a
list answer is its first element by entity id; ties of SelectAmong go to the lowest id; years match dates that
begin with them; numbers compare only within a unit; concepts count their sub-concepts at every level.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import cut

# The public language's functions, each with (sets it takes, text arguments).
SIGNATURES = {
    "FindAll": (0, 0), "Find": (0, 1), "FilterConcept": (1, 1), "FilterStr": (1, 2), "FilterNum": (1, 3), "FilterYear": (1, 3), "FilterDate": (1, 3),
    "QFilterStr": (1, 2), "QFilterNum": (1, 3), "QFilterYear": (1, 3), "QFilterDate": (1, 3), "Relate": (1, 2), "And": (2, 0), "Or": (2, 0),
    "What": (1, 0), "Count": (1, 0), "SelectBetween": (2, 2), "SelectAmong": (1, 2), "QueryAttr": (1, 1), "QueryAttrUnderCondition": (1, 3),
    "VerifyStr": (1, 1), "VerifyNum": (1, 2), "VerifyYear": (1, 2), "VerifyDate": (1, 2), "QueryRelation": (2, 0), "QueryAttrQualifier": (1, 3), "QueryRelationQualifier": (2, 2),
}
SETS = {"FindAll", "Find", "FilterConcept", "FilterStr", "FilterNum", "FilterYear", "FilterDate", "QFilterStr", "QFilterNum", "QFilterYear", "QFilterDate", "Relate", "And", "Or"}
_VALUES = {"QueryAttr", "QueryAttrUnderCondition", "QueryAttrQualifier", "QueryRelationQualifier"}
_FACTS = {f for f in SETS if "Filter" in f and f != "FilterConcept"} | {"Relate"}
# what the last argument may be, by function
_CHOICES = {"Relate": ("forward", "backward"), "SelectBetween": ("greater", "less"), "SelectAmong": ("largest", "smallest")} | {
    f + t: ("=", "!=", "<", ">") for f in ("Filter", "QFilter", "Verify") for t in ("Num", "Year", "Date")
}
_OPS = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b}


class ProgramError(ValueError):
    pass


def dependencies(functions: list[str]) -> list[list[int]]:
    """Which earlier steps each step reads: a source opens a branch, a binary function closes the last two."""
    open_, out = [], []
    for i, f in enumerate(functions):
        if f not in SIGNATURES:
            raise ProgramError(f"unknown function: {f}")
        n = SIGNATURES[f][0]
        if len(open_) < n:
            raise ProgramError(f"step {i} ({f}) needs {n} sets")
        deps = [open_.pop() for _ in range(n)][::-1]
        for k in deps:
            if functions[k] not in SETS and not f.startswith("Verify"):
                raise ProgramError(f"step {i} ({f}) reads the answer of {functions[k]}")
        out.append(deps)
        open_.append(i)
    if len(open_) != 1:
        raise ProgramError("a program ends in one result")
    return out


def validate(program: list[dict], answer: bool = True) -> list[list[int]]:
    """The steps each step reads. answer=False allows a program that ends in a set."""
    if not program:
        raise ProgramError("an empty program")
    for i, s in enumerate(program):
        f, inputs = s.get("function"), s.get("inputs", [])
        if f not in SIGNATURES:
            raise ProgramError(f"unknown function: {f}")
        if len(inputs) != SIGNATURES[f][1] or not all(isinstance(x, str) for x in inputs):
            raise ProgramError(f"step {i} ({f}) takes {SIGNATURES[f][1]} text arguments")
        if f in _CHOICES and inputs[-1] not in _CHOICES[f]:
            raise ProgramError(f"step {i} ({f}): {inputs[-1]!r} is none of {', '.join(_CHOICES[f])}")
    deps = dependencies([s["function"] for s in program])
    for i, (s, own) in enumerate(zip(program, deps)):
        f, read = s["function"], {program[k]["function"] for k in own}
        if f.startswith("QFilter") and not read <= _FACTS:
            raise ProgramError(f"step {i} ({f}) needs the facts of a filter or a relation")
        if f.startswith("Verify") and not read <= _VALUES:
            raise ProgramError(f"step {i} ({f}) needs a value")
    if answer and program[-1]["function"] in SETS:
        raise ProgramError("a program ends in an answer")
    return deps


@dataclass
class KB:
    entities: DataFrame
    concepts: DataFrame
    entity_concepts: DataFrame
    attr_facts: DataFrame
    rel_facts: DataFrame

    def run(self, program: list[dict]) -> DataFrame:
        deps = validate(program, answer=False)
        done: list[DataFrame] = []
        for s, d in zip(program, deps):
            f = s["function"]
            done.append(getattr(self, f"_{f}")(*[done[k] for k in d], *s.get("inputs", [])))
        return done[-1]

    # sets
    def _set(self, df: DataFrame, fact=None, kind: str = "") -> DataFrame:
        return df.select("entity_id", (F.lit(None).cast("string") if fact is None else fact).alias("fact_id"), F.lit(kind).alias("kind"))

    def _FindAll(self):
        return self._set(self.entities.select("entity_id").distinct())

    def _Find(self, name):
        e = self.entities.filter(F.col("name") == name).select("entity_id")
        c = self.concepts.filter(F.col("name") == name).select(F.col("concept_id").alias("entity_id"))
        return self._set(e.unionByName(c).distinct())

    def _FilterConcept(self, s, name):
        below = at = self.concepts.filter(F.col("name") == name).select("concept_id").distinct()
        while True:  # level by level until a level has no concept that is new; a circle of concepts ends, too
            at = self.concepts.join(at.withColumnRenamed("concept_id", "parent_id"), "parent_id", "left_semi").select("concept_id").distinct()
            at = cut(at.join(below, "concept_id", "left_anti"))
            if at.isEmpty():
                break
            below = cut(below.unionByName(at))
        inst = self.entity_concepts.join(below.distinct(), "concept_id", "left_semi").select("entity_id")
        return s.join(inst, "entity_id", "left_semi")

    def _facts(self, s, test) -> DataFrame:
        f = self.attr_facts.filter(test).select("entity_id", "fact_id")
        return self._set(f.join(s.select("entity_id").distinct(), "entity_id", "left_semi"), F.col("fact_id"), "attr")

    def _FilterStr(self, s, key, value):
        return self._facts(s, (F.col("key") == key) & (F.col("vstr") == value))

    def _FilterNum(self, s, key, value, op):
        number, _, unit = value.partition(" ")
        same = F.coalesce("unit", F.lit("")) == unit
        return self._facts(s, (F.col("key") == key) & same & _OPS[op](F.col("vnum"), F.lit(float(number))))

    def _FilterYear(self, s, key, value, op):
        year = F.substring("vstr", 1, 4).try_cast("int")
        return self._facts(s, (F.col("key") == key) & F.col("vtype").isin("year", "date") & _OPS[op](year, F.lit(int(value))))

    def _FilterDate(self, s, key, value, op):
        return self._facts(s, (F.col("key") == key) & (F.col("vtype") == "date") & _OPS[op](F.col("vstr"), F.lit(value)))

    def _qualified(self, s, test) -> DataFrame:
        """Keeps facts, of whichever kind the step before attached, whose qualifiers pass."""
        a = self.attr_facts.filter(test).select("fact_id", F.lit("attr").alias("kind"))
        r = self.rel_facts.filter(test).select("fact_id", F.lit("rel").alias("kind"))
        return s.join(a.unionByName(r), ["fact_id", "kind"], "left_semi").select("entity_id", "fact_id", "kind")

    def _QFilterStr(self, s, key, value):
        return self._qualified(s, F.col("qualifiers")[key] == value)

    def _QFilterNum(self, s, key, value, op):
        number, _, unit = value.partition(" ")
        q = F.split(F.col("qualifiers")[key], " ", 2)
        return self._qualified(s, (F.coalesce(F.get(q, F.lit(1)), F.lit("")) == unit) & _OPS[op](F.get(q, F.lit(0)).try_cast("double"), F.lit(float(number))))

    def _QFilterYear(self, s, key, value, op):
        return self._qualified(s, _OPS[op](F.substring(F.col("qualifiers")[key], 1, 4).try_cast("int"), F.lit(int(value))))

    def _QFilterDate(self, s, key, value, op):
        return self._qualified(s, _OPS[op](F.col("qualifiers")[key], F.lit(value)))

    def _Relate(self, s, predicate, direction):
        src, dst = ("subject", "object") if direction == "forward" else ("object", "subject")
        r = self.rel_facts.filter(F.col("predicate") == predicate).select(F.col(src).alias("entity_id"), F.col(dst).alias("_to"), "fact_id")
        hit = r.join(s.select("entity_id").distinct(), "entity_id", "left_semi")
        return self._set(hit.select(F.col("_to").alias("entity_id"), "fact_id"), F.col("fact_id"), "rel")

    def _And(self, a, b):
        return self._set(a.select("entity_id").join(b.select("entity_id"), "entity_id", "left_semi").distinct())

    def _Or(self, a, b):
        return self._set(a.select("entity_id").unionByName(b.select("entity_id")).distinct())

    # answers
    def _names(self) -> DataFrame:
        return self.entities.select("entity_id", "name").unionByName(self.concepts.select(F.col("concept_id").alias("entity_id"), "name"))

    def _What(self, s):
        return s.select("entity_id").join(self._names(), "entity_id").agg(F.min_by("name", "entity_id").alias("value"))

    def _Count(self, s):
        return s.agg(F.count_distinct("entity_id").alias("value"))

    def _values(self, s, key) -> DataFrame:
        v = self.attr_facts.filter(F.col("key") == key)
        return v.join(s.select("entity_id").distinct(), "entity_id", "left_semi")

    @staticmethod
    def _shown():
        number = F.when(F.col("vnum") == F.floor("vnum"), F.floor("vnum").cast("long").cast("string")).otherwise(F.col("vnum").cast("string"))
        return F.when(F.col("vtype") == "quantity", F.concat_ws(" ", number, F.nullif(F.coalesce("unit", F.lit("")), F.lit("")))).otherwise(F.col("vstr"))

    def _SelectAmong(self, s, key, mode):
        v = self._values(s, key).filter("vnum is not null")
        order = F.struct(-F.col("vnum") if mode == "largest" else F.col("vnum"), F.col("entity_id"))
        return v.agg(F.min_by("entity_id", order).alias("entity_id")).join(self._names(), "entity_id").select(F.col("name").alias("value"))

    def _SelectBetween(self, a, b, key, mode):
        return self._SelectAmong(a.unionByName(b), key, "largest" if mode == "greater" else "smallest")

    def _QueryAttr(self, s, key):
        return self._values(s, key).agg(F.min_by(self._shown(), F.struct("entity_id", "fact_id")).alias("value"))

    def _QueryAttrUnderCondition(self, s, key, qkey, qvalue):
        v = self._values(s, key).filter(F.col("qualifiers")[qkey] == qvalue)
        return v.agg(F.min_by(self._shown(), F.struct("entity_id", "fact_id")).alias("value"))

    def _verify(self, value, test):
        return value.select(F.when(test, "yes").otherwise("no").alias("value"))

    def _VerifyStr(self, v, expected):
        return self._verify(v, F.col("value") == expected)

    def _VerifyNum(self, v, expected, op):
        number, _, unit = expected.partition(" ")
        part = F.split("value", " ", 2)
        return self._verify(v, (F.coalesce(F.get(part, F.lit(1)), F.lit("")) == unit) & _OPS[op](F.get(part, F.lit(0)).try_cast("double"), F.lit(float(number))))

    def _VerifyYear(self, v, expected, op):
        return self._verify(v, _OPS[op](F.substring("value", 1, 4).try_cast("int"), F.lit(int(expected))))

    def _VerifyDate(self, v, expected, op):
        return self._verify(v, _OPS[op](F.col("value"), F.lit(expected)))

    def _between(self, a, b) -> DataFrame:
        r = self.rel_facts.join(a.select(F.col("entity_id").alias("subject")).distinct(), "subject", "left_semi")
        return r.join(b.select(F.col("entity_id").alias("object")).distinct(), "object", "left_semi")

    def _QueryRelation(self, a, b):
        return self._between(a, b).agg(F.min_by("predicate", F.struct("subject", "object", "fact_id")).alias("value"))

    def _QueryAttrQualifier(self, s, key, value, qkey):
        v = self._values(s, key).filter(self._shown() == value)
        return v.agg(F.min_by(F.col("qualifiers")[qkey], F.struct("entity_id", "fact_id")).alias("value"))

    def _QueryRelationQualifier(self, a, b, predicate, qkey):
        r = self._between(a, b).filter(F.col("predicate") == predicate)
        return r.agg(F.min_by(F.col("qualifiers")[qkey], F.struct("subject", "object", "fact_id")).alias("value"))


# ---- transforms of programs, on the driver (R-17..R-20, R-29)
_FUNC, _ARG = "<func>", "<arg>"


def parse(text: str) -> list[dict]:
    """R-17: steps of a program, checked. Two spellings: "Find <arg> x <func> Count", where an argument may hold anything but
    the delimiters, and "Find(x) → Count()", where a comma, an arrow or a backslash within an argument is written with a backslash."""
    steps = []
    if _FUNC in text or _ARG in text or "(" not in text:
        for part in text.split(_FUNC):
            name, *inputs = (x.strip() for x in part.split(_ARG))
            steps.append({"function": name, "inputs": inputs})
    else:
        for part in re.split(r"(?<!\\)→", text):
            m = re.fullmatch(r"\s*(\w+)\s*\((.*)\)\s*", part, re.S)
            if m is None:
                raise ProgramError(f"no step: {part.strip()!r}")
            inputs = [x.strip() for x in re.split(r"(?<!\\),", m[2])] if m[2].strip() else []
            if SIGNATURES.get(m[1], (0, 0))[1] == 1 and len(inputs) > 1:
                inputs = [m[2].strip()]  # a single argument may hold commas as they are
            steps.append({"function": m[1], "inputs": [re.sub(r"\\([,→\\])", r"\1", x) for x in inputs]})
    validate(steps)
    return steps


def serialise(program: list[dict], delimiters: bool = False) -> str:
    """R-17: the program as text that parse gives back."""
    if delimiters:
        if any(d in x for s in program for x in s.get("inputs", []) for d in (_FUNC, _ARG)):
            raise ProgramError("an argument holds a delimiter")
        return f" {_FUNC} ".join(f" {_ARG} ".join([s["function"], *s.get("inputs", [])]) for s in program)
    safe = lambda x: re.sub(r"([,→\\])", r"\\\1", x)
    return " → ".join(f"{s['function']}({', '.join(map(safe, s.get('inputs', [])))})" for s in program)


def mutations(program: list[dict], values: dict[str, list[str]]) -> list[list[dict]]:
    """R-19: programs that differ in one argument, taken from what the vocabulary has for the old one."""
    out = []
    for i, s in enumerate(program):
        for k, old in enumerate(s.get("inputs", [])):
            for new in values.get(old, []):
                if new != old:
                    inputs = [*s["inputs"][:k], new, *s["inputs"][k + 1 :]]
                    out.append([*program[:i], {"function": s["function"], "inputs": inputs}, *program[i + 1 :]])
    return out


# what kind of word each argument is; numbers, dates, values and choices are not words of the schema
_ROLES = {
    "Find": ["entity"], "FilterConcept": ["concept"], "FilterStr": ["attribute", ""], "FilterNum": ["attribute", "", ""], "FilterYear": ["attribute", "", ""], "FilterDate": ["attribute", "", ""],
    "QFilterStr": ["qualifier", ""], "QFilterNum": ["qualifier", "", ""], "QFilterYear": ["qualifier", "", ""], "QFilterDate": ["qualifier", "", ""], "Relate": ["relation", ""],
    "SelectBetween": ["attribute", ""], "SelectAmong": ["attribute", ""], "QueryAttr": ["attribute"], "QueryAttrUnderCondition": ["attribute", "qualifier", ""],
    "QueryAttrQualifier": ["attribute", "", "qualifier"], "QueryRelationQualifier": ["relation", "qualifier"],
}


def unknown_arguments(program: list[dict], schema: dict[str, set[str]]) -> list[tuple[int, int, str]]:
    """(step, argument, role) of the words that the schema (role -> words) does not have; roles it does not list are not checked."""
    return [(i, k, r) for i, s in enumerate(program) for k, r in enumerate(_ROLES.get(s["function"], [])) if r in schema and s["inputs"][k] not in schema[r]]


def repaired(program: list[dict], schema: dict[str, set[str]], likeness) -> list[dict]:
    """R-20: a program with exactly one unknown word gets the word of the same role that is most like it (ties: the first by name).

    With none, with several, or with no word of that role the program stays as it is: which of them to change cannot be told.
    """
    wrong = unknown_arguments(program, schema)
    if len(wrong) != 1 or not schema[wrong[0][2]]:
        return program
    i, k, role = wrong[0]
    s = program[i]
    new = min(schema[role], key=lambda x: (-likeness(s["inputs"][k], x), x))
    return [*program[:i], {"function": s["function"], "inputs": [*s["inputs"][:k], new, *s["inputs"][k + 1 :]]}, *program[i + 1 :]]


def flat_arguments(program: list[dict]) -> dict[str, list[str]]:
    """R-29: the arguments by function."""
    out: dict[str, list[str]] = {}
    for s in program:
        out.setdefault(s["function"], []).extend(s.get("inputs", []))
    return out

"""Records as executable step programs: problems, gold and mutant executions, rubrics, gates, twins.

All of it is column expressions over parameters; random choices are hashes of (seed, index, what), so a row is the same on
any cluster and in any order. Python runs only in ``minimal_span`` (difflib alignment) and where a verbaliser does.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from labelframe.functions import text as T
from labelframe.functions.numbers import bind, rational, rational_text, rational_tokens
from labelframe.functions.parsing import expression
from labelframe.schema import STEP
from labelframe.sources.staging import staged

LINEAR, ARITH = "一次方程式", "正負の数"
#: Error types by operator, with severity (fixed values).
LINEAR_TYPES = {"op-transpose-sign": ("記法/移項符号", 2), "op-arith-slip": ("計算/加減", 1), "op-divide-error": ("計算/除算", 2), "op-final-sign-drop": ("表記/符号落とし", 1), "op-llm-transpose-misconception": ("概念/移項", 3)}
ARITH_TYPES = {"op-arith-slip": ("計算/加減乗除", 1), "op-mult-sign-drop": ("計算/符号", 2), "op-order-of-ops": ("概念/演算順序", 3), "op-final-sign-drop": ("表記/符号落とし", 1), "op-llm-product-misconception": ("概念/符号・乗算", 3)}
#: Rubric weights to choose from: setup, working, final answer (fixed values).
RUBRICS = ((2, 4, 4), (3, 4, 3), (2, 5, 3))
MUTATION = "struct<operator:string,site:string,type:string,severity:int,delta:int,kind:string,value:bigint,tokens:array<bigint>,canonical:string>"


def choose(seed: int, key: Column, what: str, n: Column | int) -> Column:
    """A number from 0 below n by the SHA-256 of (seed, key, what): the same in any engine."""
    return F.pmod(F.conv(F.substring(hashed(seed, key, what), 1, 15), 16, 10).cast("long"), F.lit(n) if isinstance(n, int) else n.cast("long")).cast("int")


def hashed(seed: int, key: Column, what: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}|"), key.cast("string"), F.lit(f"|{what}")).cast("binary"), 256)


def chance(seed: int, key: Column, what: str, p: float) -> Column:
    return choose(seed, key, what, 1_000_000) < round(p * 1_000_000)


def _one_of(values: list[int], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at)


@dataclass(frozen=True)
class Domain:
    """A kind of problem with three whole parameters x, y, z, and its program of four steps s1 to s4. All but the names are functions that give columns.

    ``parameters(seed, fractions)``: x, y, z of an index. ``texts()``: problem text, number tokens, answer key. ``program(m)``: the steps and the answer (num, den) under a mutation struct, whose
    fields are null for the gold program. ``candidates(seed)``: the mutations that fit a row, in a fixed order. ``idle(m)``: whether a mutation changes nothing. ``proposed(expr, value)``: a
    proposal as a mutation, null unless it is allowed. ``solves(answer)``: whether an answer is right.
    """

    tag: str
    generator: str
    working: str
    parameters: Callable[[int, bool], tuple[Column, Column, Column]]
    texts: Callable[[], tuple[Column, Column, Column]]
    program: Callable[[Column], tuple[list[Column], Column]]
    candidates: Callable[[int], Column]
    idle: Callable[[Column], Column]
    proposed: Callable[[Column, Column], Column]
    solves: Callable[[Column], Column]


#: Domains by name, in the order in which problems choose among them.
DOMAINS: dict[str, Domain] = {}


def register(name: str, domain: Domain) -> None:
    """Add a domain; a name or tag that is taken is an error."""
    if name in DOMAINS or domain.tag in {d.tag for d in DOMAINS.values()}:
        raise ValueError(f"domain {name!r} or tag {domain.tag!r} is registered already")
    DOMAINS[name] = domain


def by_domain(value: Callable[[Domain], Column], domain: Column | None = None) -> Column:
    """What ``value`` gives for a row's domain; null for one that is not registered."""
    name, out = F.col("domain") if domain is None else domain, None
    for known, d in DOMAINS.items():
        out = F.when(name == known, value(d)) if out is None else out.when(name == known, value(d))
    return out


def problems(spark: SparkSession, n: int, seed: int, fractions: bool = True) -> DataFrame:
    """``n`` rows: idx, domain, x, y, z, text and number tokens, answer key."""
    names = F.array(*map(F.lit, DOMAINS))
    rows = spark.range(n).select(F.col("id").alias("idx"), F.get(names, choose(seed, F.col("id"), "domain", len(DOMAINS))).alias("domain"))
    return with_texts(rows.select("idx", "domain", *(by_domain(lambda d, k=k: d.parameters(seed, fractions)[k]).alias(c) for k, c in enumerate("xyz"))))


def _paren(shown: Column) -> Column:
    return F.when(shown.startswith("-"), F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)


def with_texts(rows: DataFrame) -> DataFrame:
    """Problem text, number tokens and answer key of (domain, x, y, z)."""
    return rows.select("*", *(by_domain(lambda d, k=k: d.texts()[k]).alias(c) for k, c in enumerate(("problem_text", "problem_numbers", "answer_key"))))


def _step(step_id: str, op: str | Column, text: Column, numbers: Column) -> Column:
    op = F.lit(op) if isinstance(op, str) else op
    return F.struct(F.lit(step_id).alias("step_id"), op.alias("op"), text.alias("text"), text.alias("latex"), numbers.alias("numbers"), F.lit(None).cast("string").alias("text_template")).cast(STEP)


def execute(mutation: Column | None = None, domain: Column | None = None) -> tuple[Column, Column]:
    """(steps, answer) of the program over x, y, z under a mutation struct (null: gold); the answer is a rational."""
    m = mutation if mutation is not None else F.lit(None).cast(MUTATION)
    return by_domain(lambda d: F.array(*d.program(m)[0]), domain), by_domain(lambda d: d.program(m)[1], domain)


def _is(m: Column, op: str, site: str) -> Column:
    return F.coalesce((m["operator"] == op) & (m["site"] == site), F.lit(False))


def _mutation(op: str, site: str | Column, types: dict, delta: Column | None = None, kind: Column | None = None, value: Column | None = None, tokens: Column | None = None, canonical: Column | None = None) -> Column:
    none = lambda c, t: F.lit(None).cast(t) if c is None else c.cast(t)
    site = F.lit(site) if isinstance(site, str) else site
    fields = [F.lit(op).alias("operator"), site.alias("site"), F.lit(types[op][0]).alias("type"), F.lit(types[op][1]).alias("severity"), none(delta, "int").alias("delta"), none(kind, "string").alias("kind"), none(value, "bigint").alias("value"), none(tokens, "array<bigint>").alias("tokens"), none(canonical, "string").alias("canonical")]
    return F.struct(*fields).cast(MUTATION)


def candidates(seed: int) -> Column:
    """The mutations that fit a row's parameters, in a fixed order."""
    return by_domain(lambda d: F.array_compact(d.candidates(seed)))


def chosen_mutation(seed: int) -> Column:
    """One candidate; the first that changes its step instead of one that does not."""
    some = candidates(seed)
    one = F.get(some, choose(seed, F.col("idx"), "mutation", F.size(some)))
    return F.when(by_domain(lambda d: d.idle(one)), F.get(some, 0)).otherwise(one)


def proposed_mutation(expr: Column, value: Column) -> Column:
    """A proposal (parsed expression struct, and whole number) as a mutation; null unless the domain allows it."""
    return by_domain(lambda d: d.proposed(expr, value))


def _slip(seed: int) -> Column:
    return _one_of([-2, -1, 1, 2], choose(seed, F.col("idx"), "delta", 4))


_NONZERO = [v for v in range(-9, 10) if v]


class Linear:
    """a x + b = c, with a whole root from -9 to 9 or (for two of five) one that is not whole."""

    @staticmethod
    def parameters(seed: int, fractions: bool) -> tuple[Column, Column, Column]:
        k = F.col("idx")
        pick = lambda what, m: choose(seed, k, what, m)
        a, b, free = _one_of([2, 3, 4, 5, -2, -3], pick("a", 6)), _one_of(_NONZERO, pick("b", 18)), pick("c", 41) - 20
        forced = free + F.when((free - b) % F.abs(a) == 0, 1).otherwise(0)
        return a, b, F.when(chance(seed, k, "fraction", 0.4 if fractions else 0.0), forced).otherwise(a * (pick("root", 19) - 9) + b)

    @staticmethod
    def texts() -> tuple[Column, Column, Column]:
        x, size, z = F.col("x").cast("string"), F.abs("y").cast("string"), F.col("z").cast("string")
        text = F.concat(F.lit("次の方程式を解きなさい。 "), x, F.lit("x "), F.when(F.col("y") > 0, "+").otherwise("-"), F.lit(" "), size, F.lit(" = "), z)
        return text, F.array(x, size, z), rational_text(rational((F.col("z") - F.col("y")).cast("long"), F.col("x").cast("long")))

    @staticmethod
    def program(m: Column) -> tuple[list[Column], Column]:
        x, y, z = (F.col(c).cast("long") for c in "xyz")
        s = lambda c: c.cast("string")
        size = F.abs(y)
        setup = _step("s1", "setup", F.concat(s(x), F.lit("x "), F.when(y > 0, "+").otherwise("-"), F.lit(" "), s(size), F.lit(" = "), s(z)), F.array(s(x), s(size), s(z)))
        told = _is(m, "op-llm-transpose-misconception", "s2")
        minus = (y > 0) != _is(m, "op-transpose-sign", "s2")
        moved = F.when(told, m["value"]).when(minus, z - size).otherwise(z + size)
        right = F.when(told, m["canonical"]).otherwise(F.concat(s(z), F.when(minus, " - ").otherwise(" + "), s(size)))
        used = F.when(told, F.concat(F.array(s(x)), F.transform(m["tokens"], lambda t: t.cast("string")))).otherwise(F.array(s(x), s(z), s(size)))
        transpose = _step("s2", "transpose", F.concat(s(x), F.lit("x = "), right), used)
        d = moved + F.when(_is(m, "op-arith-slip", "s3"), m["delta"]).otherwise(0)
        simplify = _step("s3", "simplify", F.concat(s(x), F.lit("x = "), s(d)), F.array(s(x), s(d)))
        wrong = _is(m, "op-divide-error", "s4")
        num = F.when(wrong & (m["kind"] == "mul"), d * x).when(wrong, d + m["delta"] * x).otherwise(d)
        root = rational(num, F.when(wrong & (m["kind"] == "mul"), F.lit(1).cast("long")).otherwise(x))
        root = bind(root, lambda r: F.struct(F.when(_is(m, "op-final-sign-drop", "s4"), F.abs(r["num"])).otherwise(r["num"]).alias("num"), r["den"].alias("den")))
        divide = bind(root, lambda r: _step("s4", "divide", F.concat(F.lit("x = "), rational_text(r)), rational_tokens(r)))
        return [setup, transpose, simplify, divide], root

    @staticmethod
    def candidates(seed: int) -> Column:
        k = F.col("idx")
        off, kind = _one_of([-1, 1], choose(seed, k, "off", 2)), F.when(choose(seed, k, "kind", 2) == 0, "mul").otherwise("off")
        negative = (F.col("z") - F.col("y")) * F.signum(F.col("x").cast("double")) < 0
        return F.array(_mutation("op-transpose-sign", "s2", LINEAR_TYPES), _mutation("op-arith-slip", "s3", LINEAR_TYPES, _slip(seed)), _mutation("op-divide-error", "s4", LINEAR_TYPES, off, kind), F.when(negative, _mutation("op-final-sign-drop", "s4", LINEAR_TYPES)))

    @staticmethod
    def idle(m: Column) -> Column:
        """Multiplying 0 where 0 was to be divided."""
        return (m["operator"] == "op-divide-error") & (m["kind"] == "mul") & (F.col("z") == F.col("y"))

    @staticmethod
    def proposed(expr: Column, value: Column) -> Column:
        """An expression of the constants |b| and |c| only, of another value than c - b."""
        b, c = F.abs(F.col("y")).cast("long"), F.abs(F.col("z")).cast("long")
        allowed = expr["failure"].isNull() & F.forall(expr["tokens"], lambda t: F.abs(t).isin(b, c)) & (expr["value"] != F.col("z") - F.col("y"))
        return F.when(allowed, _mutation("op-llm-transpose-misconception", "s2", LINEAR_TYPES, value=expr["value"], tokens=expr["tokens"], canonical=expr["canonical"]))

    @staticmethod
    def solves(answer: Column) -> Column:
        x, y, z = (F.col(c).cast("long") for c in "xyz")
        return x * answer["num"] + y * answer["den"] == z * answer["den"]


class Arithmetic:
    """p + q × r."""

    @staticmethod
    def parameters(seed: int, fractions: bool) -> tuple[Column, Column, Column]:
        p, q, r = (_one_of(_NONZERO, choose(seed, F.col("idx"), what, 18)) for what in "pqr")
        return p, q, r

    @staticmethod
    def texts() -> tuple[Column, Column, Column]:
        x, y, z = (F.col(c).cast("string") for c in "xyz")
        return F.concat(F.lit("次の計算をしなさい。 "), x, F.lit(" + "), _paren(y), F.lit(" × "), _paren(z)), F.array(x, y, z), (F.col("x") + F.col("y") * F.col("z")).cast("string")

    @staticmethod
    def program(m: Column) -> tuple[list[Column], Column]:
        x, y, z = (F.col(c).cast("long") for c in "xyz")
        s = lambda c: c.cast("string")
        either = lambda a, b: F.when(left_first, a).otherwise(b)
        first = _step("s1", "setup", F.concat(s(x), F.lit(" + "), _paren(s(y)), F.lit(" × "), _paren(s(z))), F.array(s(x), s(y), s(z)))
        left_first, t = _is(m, "op-order-of-ops", "s2"), x + y
        product = F.when(_is(m, "op-llm-product-misconception", "s2"), m["value"]).when(_is(m, "op-mult-sign-drop", "s2"), F.abs(y * z)).otherwise(y * z + F.when(_is(m, "op-arith-slip", "s2"), m["delta"]).otherwise(0))
        total = either(t * z, x + product + F.when(_is(m, "op-arith-slip", "s3"), m["delta"]).otherwise(0))
        line = lambda a, sign, b, v: F.concat(a, F.lit(f" {sign} "), b, F.lit(" = "), s(v))
        second = _step("s2", either(F.lit("add_first"), F.lit("multiply")), either(line(s(x), "+", _paren(s(y)), t), line(_paren(s(y)), "×", _paren(s(z)), product)), either(F.array(s(x), s(y), s(t)), F.array(s(y), s(z), s(product))))
        third = _step("s3", either(F.lit("mul_second"), F.lit("add")), either(line(_paren(s(t)), "×", _paren(s(z)), total), line(s(x), "+", _paren(s(product)), total)), either(F.array(s(t), s(z), s(total)), F.array(s(x), s(product), s(total))))
        answer = F.when(_is(m, "op-final-sign-drop", "s4"), F.abs(total)).otherwise(total)
        last = _step("s4", "answer", F.concat(F.lit("答え "), s(answer)), F.array(s(answer)))
        return [first, second, third, last], F.struct(answer.alias("num"), F.lit(1).cast("long").alias("den"))

    @staticmethod
    def candidates(seed: int) -> Column:
        site = F.when(choose(seed, F.col("idx"), "slip_site", 2) == 0, "s2").otherwise("s3")
        x, y, z = map(F.col, "xyz")
        return F.array(_mutation("op-arith-slip", site, ARITH_TYPES, _slip(seed)), F.when(y * z < 0, _mutation("op-mult-sign-drop", "s2", ARITH_TYPES)), F.when((z != 1) & (y != 0), _mutation("op-order-of-ops", "s2", ARITH_TYPES)), F.when(x + y * z < 0, _mutation("op-final-sign-drop", "s4", ARITH_TYPES)))

    @staticmethod
    def idle(m: Column) -> Column:
        return F.lit(False)

    @staticmethod
    def proposed(expr: Column, value: Column) -> Column:
        """Another value than q r, at most 30 off its size."""
        gold = (F.col("y") * F.col("z")).cast("long")
        return F.when((value != gold) & (F.abs(value) <= F.abs(gold) + 30), _mutation("op-llm-product-misconception", "s2", ARITH_TYPES, value=value))

    @staticmethod
    def solves(answer: Column) -> Column:
        x, y, z = (F.col(c).cast("long") for c in "xyz")
        return (answer["num"] == x + y * z) & (answer["den"] == 1)


def _domain(tag: str, generator: str, working: str, kind: type) -> Domain:
    return Domain(tag, generator, working, kind.parameters, kind.texts, kind.program, kind.candidates, kind.idle, kind.proposed, kind.solves)


register(LINEAR, _domain("lin", "bootstrap/linear_1var@v0.1", "変形過程", Linear))
register(ARITH, _domain("ar", "bootstrap/int_arith@v0.1", "途中の計算", Arithmetic))


#: A proposer: (domain, the three parameters) to the text of what a learner with a misconception would write; it may raise.
Proposer = Callable[[str, int, int, int], str]


def with_proposals(rows: DataFrame, proposer: Proposer, retries: int = 2) -> DataFrame:
    """``rows`` (domain, x, y, z) with ``proposed``: the proposal read as an expression (linear rows) or as a whole number; nulls where the proposer failed each time."""

    @F.pandas_udf("string")
    def ask(domain: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        out = []
        for row in zip(domain, x, y, z, strict=True):
            said = None
            for _ in range(retries + 1):
                try:
                    said = str(proposer(row[0], *map(int, row[1:])))
                    break
                except Exception:  # an outside service may fail in any way
                    continue
            out.append(said)
        return pd.Series(out, dtype=object)

    rows = rows.withColumn("_said", ask("domain", "x", "y", "z"))
    value = F.when(F.trim("_said").rlike(r"^[+-]?[0-9]{1,18}$"), F.trim("_said").try_cast("bigint"))
    return rows.withColumn("proposed", F.struct(expression("_said").alias("expr"), value.alias("value"))).drop("_said")


@F.pandas_udf(ArrayType(IntegerType()))
def minimal_span(gold: pd.Series, mutant: pd.Series) -> pd.Series:
    """[lo, hi) of the mutant text around all that an alignment with the gold text changes; one character at least."""

    def one(a: str | None, b: str | None) -> list[int] | None:
        if a is None or b is None:
            return None
        changed = [(lo, hi) for tag, _, _, lo, hi in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if tag != "equal"]
        lo, hi = (min(c[0] for c in changed), max(c[1] for c in changed)) if changed else (0, len(b))
        return [lo, hi if hi > lo else min(len(b), lo + 1)]

    return pd.Series([one(a, b) for a, b in zip(gold, mutant, strict=True)], index=gold.index)


def step_text(steps: Column, step_id: Column, field: str = "text") -> Column:
    """The text of a step by its id; null if there is none."""
    return F.get(F.filter(steps, lambda s: s["step_id"] == step_id), 0)[field]


def required_step(steps: Column, step_id: Column, field: str = "latex") -> Column:
    """``step_text``, but a missing step is an error."""
    return F.coalesce(step_text(steps, step_id, field), F.raise_error(F.concat(F.lit("no step "), F.coalesce(step_id, F.lit("null")))).cast("string"))


def affected_steps(site: Column, gold: Column, mutant: Column) -> Column:
    """Ids of the later steps whose text differs."""
    later = F.filter(F.array(F.lit("s2"), F.lit("s3"), F.lit("s4")), lambda i: i > site)
    return F.filter(later, lambda i: step_text(gold, i) != step_text(mutant, i))


def rubric(seed: int) -> Column:
    """Weights of a row's rubric: the same for twins, as it depends on index and domain only."""
    which = choose(seed, F.concat(F.col("idx").cast("string"), F.col("domain")), "rubric", len(RUBRICS))
    middle = by_domain(lambda d: F.lit(d.working))
    w = [F.get(F.array(*(F.lit(r[i]) for r in RUBRICS)), which) for i in range(3)]
    text = F.concat(F.lit("採点基準:立式 "), w[0], F.lit(" 点、"), middle, F.lit(" "), w[1], F.lit(" 点、最終解 "), w[2], F.lit(" 点(計 10 点)"))
    weights = F.map_from_arrays(F.array(F.lit("立式"), middle, F.lit("最終解")), F.array(*w))
    return F.struct(F.concat(F.lit("rb-"), by_domain(lambda d: F.lit(d.tag)), F.lit("-w"), *w).alias("fn_id"), weights.alias("weights"), text.alias("text_ja"))


def awarded(w: list[Column], site: Column, affected: Column, final_ok: Column) -> Column:
    """Points: setup unless it is dirty, the working by its clean share (floored), the final answer if right. Dirty: the site and what it affects."""
    dirty = lambda i: (site == i) | F.array_contains(affected, i)
    clean = F.when(dirty("s2"), 0).otherwise(1) + F.when(dirty("s3"), 0).otherwise(1)
    return (F.when(dirty("s1"), 0).otherwise(w[0]) + F.floor(w[1] * clean / 2) + F.when(final_ok, w[2]).otherwise(0)).cast("int")


def check_texts(steps: Column, texts: Column) -> Column:
    """Ids of the steps whose new text fails: expected numbers missing or out of order, unknown numbers, or the expression itself missing.

    Known numbers are those of all given steps and their negatives. Texts of answers must hold 答 and the last number; others the
    template, white space and width aside. ``steps`` and ``texts`` are columns of the frame (an Arrow function normalises them).
    """
    numbers = F.flatten(F.transform(steps, lambda s: s["numbers"]))
    known = F.array_union(numbers, F.transform(numbers, lambda t: F.when(t.startswith("-"), F.substring(t, F.lit(2), F.length(t))).otherwise(F.concat(F.lit("-"), t))))
    template = T.normalize_all(F.transform(steps, lambda s: F.coalesce(s["text_template"], s["text"])))
    said = T.normalize_all(texts)

    def fails(s: Column, text: Column, norm: Column, want: Column) -> Column:
        actual = T.number_tokens(text)
        form = F.when(s["op"] == "answer", norm.contains("答") & (F.size(s["numbers"]) > 0) & F.array_contains(actual, F.element_at(s["numbers"], -1))).otherwise(F.contains(norm, want))
        return ~T.is_subsequence(s["numbers"], actual) | F.exists(actual, lambda t: ~F.array_contains(known, t)) | ~form

    zipped = F.arrays_zip(steps.alias("s"), texts.alias("t"), said.alias("n"), template.alias("w"))
    return F.transform(F.filter(zipped, lambda z: fails(z["s"], z["t"], z["n"], z["w"])), lambda z: z["s"]["step_id"])


def gate_one(rows: DataFrame) -> DataFrame:
    """``rows`` (with gold and answer) and ``g1_reasons``: the answer must solve the problem and be its key, texts must hold the program's numbers."""
    ans = F.col("answer")
    solves = F.coalesce(by_domain(lambda d: d.solves(ans)), F.lit(False))
    # 3x + 4: the minus before a subtracted number is an operator with a space, so it never joins the token
    same = T.number_tokens(F.col("problem_text")) == F.col("problem_numbers")
    failed = check_texts(F.col("gold"), F.transform("gold", lambda s: s["text"]))
    reasons = F.array_compact(F.array(F.when(~solves, "G1a: the answer does not solve the problem"), F.when(rational_text(ans) != F.col("answer_key"), "G1a: the answer is not the key"), F.when(~same, "G1b: numbers of the problem text differ"), F.when(F.col("domain").isNull() | F.col("problem_text").isNull() | F.col("answer_key").isNull(), "G1c: a field is missing")))
    return rows.withColumn("g1_reasons", F.concat(reasons, F.transform(failed, lambda i: F.concat(F.lit("G1b: numbers of "), i, F.lit(" differ")))))


def gate_two(gold: Column, mutant: Column, again: Column, site: Column, affected: Column, span: Column) -> Column:
    """Reasons against an error record: changes beyond the site and what it affects, no change at the site, another re-execution, an unsound span."""
    texts = lambda steps: F.transform(steps, lambda s: s["text"])

    def reasons(v: Column) -> Column:
        changed = F.filter(F.transform(v["gold"], lambda s: s["step_id"]), lambda i: ~step_text(v["gold"], i).eqNullSafe(F.coalesce(step_text(v["mutant"], i), F.lit(""))))
        lo, hi = F.get(v["span"], 0), F.get(v["span"], 1)
        sound = (lo >= 0) & (lo < hi) & (hi <= F.length(step_text(v["mutant"], v["site"])))

        def against(c: Column) -> Column:
            beyond = F.when(F.size(c["beyond"]) > 0, F.concat(F.lit("G2a: changes beyond: "), F.array_join(c["beyond"], ",")))
            return F.array_compact(F.array(beyond, F.when(~F.array_contains(c["changed"], v["site"]), "G2a: no change at the site"), F.when(~v["again"].eqNullSafe(texts(v["mutant"])), "G2b: re-execution differs"), F.when(~F.coalesce(sound, F.lit(False)), "G2b: unsound span")))

        own = lambda c: F.struct(c.alias("changed"), F.array_except(c, F.concat(F.array(v["site"]), v["affected"])).alias("beyond"))
        return bind(bind(changed, own), against)

    given = {"gold": gold, "mutant": mutant, "again": texts(again), "site": site, "affected": affected, "span": span}
    return bind(F.struct(*(c.alias(k) for k, c in given.items())), reasons)


def records(made: DataFrame, seed: int) -> DataFrame:
    """Typed records of problems with a mutation (null: a control), in the record schema without ``render``; ``g2_reasons`` beside it."""
    gold, gold_answer = execute()
    rows = made.withColumn("gold", gold).withColumn("answer", gold_answer)
    rows = gate_one(rows)
    mutant, mutant_answer = execute(F.col("mutation"))
    control = F.col("mutation").isNull()
    rows = rows.withColumn("mutant", F.when(~control, mutant)).withColumn("mutant_answer", mutant_answer)
    site = F.col("mutation.site")
    rows = rows.withColumn("affected", F.when(~control, affected_steps(site, F.col("gold"), F.col("mutant"))))
    rows = rows.withColumn("span", minimal_span(F.when(~control, step_text(F.col("gold"), site)), F.when(~control, step_text(F.col("mutant"), site))))
    rows = rows.withColumn("g2_reasons", F.when(control, F.array().cast("array<string>")).otherwise(gate_two(F.col("gold"), F.col("mutant"), mutant, site, F.col("affected"), F.col("span"))))
    rows = rows.withColumn("rubric", rubric(seed))
    middle = by_domain(lambda d: F.lit(d.working))
    w = [F.col("rubric.weights")[k] if isinstance(k, str) else F.element_at("rubric.weights", k) for k in ("立式", middle, "最終解")]
    right = (F.col("mutant_answer.num") == F.col("answer.num")) & (F.col("mutant_answer.den") == F.col("answer.den"))
    points = F.when(control, 10).otherwise(awarded(w, site, F.col("affected"), right))
    pair = F.format_string("math-g7-%s-%06d", by_domain(lambda d: F.lit(d.tag)), F.col("idx"))
    on_page = F.when(control, F.col("gold")).otherwise(F.col("mutant"))
    error = F.struct(F.col("mutation.type").alias("type"), F.col("mutation.operator").alias("operator"), site.alias("mutation_site"), F.col("affected").alias("causally_affected_nodes"), F.col("span").alias("span"), F.col("mutation.severity").alias("severity"), (F.size("affected") > 0).alias("propagates"), F.lit(None).cast("string").alias("type_identifiable"), F.lit(None).cast("boolean").alias("ambiguous_cross_family"))
    gates = F.when(control, F.array(F.lit("G1"))).otherwise(F.array(F.lit("G1"), F.lit("G2a"), F.lit("G2b")))
    generator = by_domain(lambda d: F.lit(d.generator))
    return rows.select(
        F.concat(pair, F.when(control, "-e0").otherwise("-e1")).alias("sample_id"), pair.alias("pair_id"),
        F.struct(F.col("problem_text").alias("text_ja"), F.lit(7).alias("grade"), F.col("domain"), generator.alias("generator")).alias("problem"),
        F.col("gold").alias("gold_solution"), F.struct(F.col("answer_key").alias("final"), F.lit("fraction-exact").alias("verified_by")).alias("answer_key"), "rubric",
        F.when(control, F.array()).otherwise(F.array(error)).alias("injected_errors"), F.when(control, F.slice("gold", 1, 0)).otherwise(F.col("mutant")).alias("mutant_solution"),
        F.struct(F.concat(F.col("problem_text"), F.lit("\n"), F.array_join(F.transform(on_page, lambda s: s["text"]), "\n")).alias("text"), F.lit("NFKC+strip-space").alias("normalization")).alias("transcript_gt"),
        F.struct(F.lit(10).alias("full"), points.alias("awarded")).alias("score_gt"), F.struct(control.alias("error_free")).alias("control_flag"),
        F.struct(F.lit("phase0-bootstrap-v0.2").alias("pipeline"), gates.alias("gates_passed"), F.lit("template").alias("verbalizer")).alias("provenance"),
        "g1_reasons", "g2_reasons",
    )


def generate(spark: SparkSession, n: int, seed: int, control_share: float = 0.3, fractions: bool = True, proposer: Proposer | None = None) -> DataFrame:
    """About ``n`` records: errors, and control twins (same pair) of those errors whose hashes come first.

    Exactly round(n control_share) twins are drawn without replacement: rows with the least hashes of their index. A ``proposer`` gives the mutations
    where its proposals are allowed.
    """
    n_errors = round(n * (1 - control_share))
    made = problems(spark, n_errors, seed, fractions)
    # written, for the programs use a mutation in many places and would carry its whole expression to each
    made = made.withColumn("mutation", chosen_mutation(seed)) if proposer is None else with_proposals(made, proposer).withColumn("mutation", F.coalesce(proposed_mutation(F.col("proposed.expr"), F.col("proposed.value")), chosen_mutation(seed))).drop("proposed")
    made = staged(made)
    twins = made.where(least_hashes(made, hashed(seed, F.col("idx"), "twin"), "idx", min(n - n_errors, n_errors))).withColumn("mutation", F.lit(None).cast(MUTATION))
    return records(made.unionByName(twins), seed)


def least_hashes(rows: DataFrame, h: Column, key: str, k: int, digits: int = 4) -> Column:
    """Whether a row is among the ``k`` with the least (hex hash, key); keys are distinct. No task sorts more than the rows that share the last one's first ``digits`` digits, and rows stay where they are."""
    if k <= 0:
        return F.lit(False)
    head, left = F.substring(h, 1, digits), k
    for start, n in sorted((r[0], r[1]) for r in rows.groupBy(head.alias("d")).count().collect()):  # 16^digits counts at most
        if n >= left:
            last = rows.select(h.alias("h"), key).where(F.substring("h", 1, digits) == start).orderBy("h", key).limit(left).agg(F.max(F.struct("h", key))).first()[0]
            return (h < last["h"]) | ((h == last["h"]) & (F.col(key) <= last[key]))
        left -= n
    return F.lit(True)


def batch_stats(rows: DataFrame) -> DataFrame:
    """One row: gate counters, kept records and their share of controls."""
    g1, g2 = F.size("g1_reasons") == 0, F.size("g2_reasons") == 0
    kept = g1 & g2
    n_kept = F.count_if(kept)
    return rows.agg(F.count(F.lit(1)).alias("n_generated"), F.count_if(g1).alias("g1_pass"), F.count_if(~g1).alias("g1_fail"), F.count_if(g1 & g2).alias("g2_pass"), F.count_if(g1 & ~g2).alias("g2_fail"), (F.count_if(kept & F.col("control_flag.error_free")) / F.greatest(F.lit(1), n_kept)).alias("control_ratio"))


def per_operator(rows: DataFrame) -> DataFrame:
    """Records per operator; controls count as (control)."""
    operator = F.coalesce(F.get("injected_errors", 0)["operator"], F.lit("(control)"))
    return rows.groupBy(operator.alias("operator")).agg(F.count(F.lit(1)).alias("n"))


def namespaced(rows: DataFrame, chunk: Column) -> DataFrame:
    """Ids with their chunk's prefix."""
    prefix = F.format_string("c%03d-", chunk)
    return rows.withColumns({c: F.concat(prefix, F.col(c)) for c in ("sample_id", "pair_id")})

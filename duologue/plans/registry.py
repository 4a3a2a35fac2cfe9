"""Measures as column expressions over a few fused aggregates.

A *fact table* is one aggregate over one input, keyed by (session_id, person) or by session_id. A
measure names the fact tables it reads and gives an expression over their columns; dyad measures
see both persons' columns as ``a_<name>`` and ``b_<name>``. ``compute`` builds each fact table that
the requested measures need once, however many of them read it, joins them to the full spine and
unpivots, so no row is lost: what has no value is NULL with a reason. Rows are joined while they are
one a person or session, never when they are one a measure.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duologue.plans.catalogue import SPECS, Spec
from duologue.plans.corpus import PERSONS, Corpus

FactBuilder = Callable[[Corpus], DataFrame]
PERSON_FACTS: dict[str, FactBuilder] = {}
SESSION_FACTS: dict[str, FactBuilder] = {}


@dataclass(frozen=True)
class Measure:
    spec: Spec
    facts: tuple[str, ...]
    value: Callable[[], Column]


MEASURES: dict[str, Measure] = {}


def person_facts(name: str):
    def add(builder: FactBuilder) -> FactBuilder:
        PERSON_FACTS[name] = builder
        return builder

    return add


def session_facts(name: str):
    def add(builder: FactBuilder) -> FactBuilder:
        SESSION_FACTS[name] = builder
        return builder

    return add


def register(id_: str, facts: str, value: Callable[[], Column], spec: Spec | None = None) -> None:
    """Adds a measure; an id that is taken is an error. ``spec`` describes measures outside the catalogue."""
    if id_ in MEASURES:
        raise ValueError(f"measure {id_!r} is registered already")
    MEASURES[id_] = Measure(spec or SPECS[id_], tuple(facts.split()), value)


def per_minute(count: Column, seconds: Column) -> Column:
    return count / F.greatest(seconds / 60.0, F.lit(1e-9))


def _numbers(rows: DataFrame, keys: list[str], measures: list[Measure], able: list[Measure]) -> DataFrame:
    none = F.lit(None).cast("double")
    if not measures:
        return rows.select(*keys, F.lit("").alias("measure"), none.alias("value")).limit(0)
    wide = rows.select(*keys, *((F.nanvl(m.value().cast("double"), none) if m in able else none).alias(m.spec.id) for m in measures))
    return wide.unpivot(keys, [m.spec.id for m in measures], "measure", "value")


def compute(corpus: Corpus, only: Iterable[str] | None = None) -> DataFrame:
    """(session_id, person, measure, value, unavailable_reason); person is 'dyad' for dyad measures."""
    wanted = [MEASURES[i] for i in (sorted(MEASURES, key=lambda i: (MEASURES[i].spec.family, i)) if only is None else only)]
    present = corpus.present()
    # what no session can have is not computed; its rows have no value
    able = [m for m in wanted if all(present.get(r, True) for r in m.spec.requires)]
    names = list(dict.fromkeys(f for m in able for f in m.facts))
    base = corpus.inputs

    def gathered(keys: list[str], spine: DataFrame, facts: list[DataFrame]) -> tuple[DataFrame, list[str]]:
        """The spine with all facts' columns: one bag of rows and one aggregate, however many tables there are."""
        columns = [c for f in facts for c in f.columns if c not in keys]
        if not columns:
            return spine, columns
        bag = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), facts)
        return spine.join(bag.groupBy(*keys).agg(*(F.max(c).alias(c) for c in columns)).hint("merge"), keys, "left"), columns

    people, columns = gathered(["session_id", "person"], base.withColumn("person", F.explode(F.array(*map(F.lit, PERSONS)))), [PERSON_FACTS[n](corpus) for n in names if n in PERSON_FACTS])
    dyads, _ = gathered(["session_id"], base, [SESSION_FACTS[n](corpus) for n in names if n in SESSION_FACTS])
    people = corpus.hold(people)
    if any(m.spec.level == "dyad" for m in able) and columns:
        pair = people.groupBy("session_id").agg(*(F.max(F.when(F.col("person") == p, F.col(c))).alias(f"{p.lower()}_{c}") for p in "AB" for c in columns))
        dyads = dyads.join(pair.hint("merge"), "session_id", "left")
    at = lambda level: [m for m in wanted if m.spec.level == level]
    person = _numbers(people, ["session_id", "person", "have"], at("person"), able)
    values = person.unionByName(_numbers(dyads, ["session_id", "have"], at("dyad"), able).withColumn("person", F.lit("dyad")))
    listed = [(m.spec.id, list(m.spec.requires)) for m in wanted]
    catalogue = F.broadcast(corpus.sessions.sparkSession.createDataFrame(listed, "measure string, needs array<string>"))
    rows = values.join(catalogue, "measure")
    lacking = F.array_except("needs", "have")
    missing = F.size(lacking) > 0
    finite = F.col("value").isNotNull() & (F.abs("value") < float("inf"))
    return rows.select(
        "session_id",
        "person",
        "measure",
        F.when(~missing & finite, F.col("value")).alias("value"),
        F.when(missing, F.concat(F.lit("requires "), F.array_join(lacking, ", "))).when(~finite | F.col("value").isNull(), F.lit("value is not finite")).alias("unavailable_reason"),
    )

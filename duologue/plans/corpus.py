"""A corpus: the tables that measures are computed from, for all sessions at once."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duologue.operators import semantics, turns
from duologue.settings import Settings

PERSONS = ("A", "B")


@dataclass
class Corpus:
    """Tables by their schema in ``duologue.sources.schemas``; None where an input does not exist.

    ``artifacts`` (session_id, name) says which inputs single sessions have; by default every
    session has those whose table is given.
    """

    sessions: DataFrame
    speech: DataFrame | None = None
    words: DataFrame | None = None
    spans: DataFrame | None = None
    frames: DataFrame | None = None
    voice: DataFrame | None = None
    embeddings: DataFrame | None = None
    state: DataFrame | None = None
    artifacts: DataFrame | None = None
    turns: DataFrame | None = None
    settings: Settings = field(default_factory=Settings)
    #: Tables that several measures share, by name, and what is persisted for this corpus.
    made: dict[str, DataFrame] = field(default_factory=dict, repr=False)
    held: list[DataFrame] = field(default_factory=list, repr=False)

    def hold(self, df: DataFrame) -> DataFrame:
        """Persists a table that is read more than once, until ``release``."""
        self.held.append(df.persist())
        return df

    def release(self) -> None:
        """Lets go of all that is persisted; results that were not written are computed anew when read again."""
        while self.held:
            self.held.pop().unpersist()

    def __enter__(self) -> Corpus:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()

    @cached_property
    def turn_set(self) -> turns.TurnSet:
        made = turns.build_turn_set(self.speech, self.words, self.settings.turns, self.hold)
        if self.turns is not None:  # turns given as a table are taken as they are
            non_floor = made.ipus.limit(0)
            made = turns.TurnSet(made.speech, made.ipus, made.backchannels, self.turns, non_floor, turns.find_interruptions(self.turns, non_floor, made.speech, self.settings.turns))
        return made

    @cached_property
    def usable_turns(self) -> DataFrame:
        return self.hold(semantics.usable_turns(self.turn_set.turns, self.embeddings, self.settings.semantic))

    @cached_property
    def spine(self) -> DataFrame:
        return self.sessions.select("session_id", F.explode(F.array(*map(F.lit, PERSONS))).alias("person"))

    def present(self) -> dict[str, bool]:
        has = {"face": {"tracked"}, "prosody": {"f0_hz"}, "body": {"wrist_speed"}}
        columns = set(self.frames.columns) if self.frames is not None else set()
        kinds = self.spans is not None
        return {
            "turn_set": self.speech is not None,
            "transcript": self.words is not None,
            "semantics": self.embeddings is not None,
            "laughter": kinds,
            "filled_pauses": kinds,
            **{name: need <= columns for name, need in has.items()},
        }

    @cached_property
    def inputs(self) -> DataFrame:
        """(session_id, duration_s, frame_hz, have): ``have`` are the names of each session's inputs."""
        names = [n for n, there in self.present().items() if there]
        every = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
        if self.artifacts is not None:
            own = self.artifacts.filter(F.col("name").isin(*self.present())).groupBy("session_id").agg(F.collect_set("name").alias("own"))
            base = self.sessions.join(own, "session_id", "left").withColumn("every", F.array_intersect(every, F.coalesce("own", F.array().cast("array<string>"))))
        else:
            base = self.sessions.withColumn("every", every)
        overlap = F.when(F.col("overlap_identifiable") & F.array_contains("every", "turn_set"), F.array(F.lit("overlap_evidence"))).otherwise(F.array().cast("array<string>"))
        return base.select("session_id", "duration_s", "frame_hz", F.concat("every", overlap).alias("have"))

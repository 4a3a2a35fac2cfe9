"""Links between turns: callbacks, coherence, topics, from embeddings and content terms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duologue.functions.text import content_terms, content_words, tokens
from duologue.settings import SemanticSettings


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.aggregate(products, F.lit(0.0), lambda s, x: s + x)))


def usable_turns(turns: DataFrame, embeddings: DataFrame, cfg: SemanticSettings) -> DataFrame:
    """(session_id, pos, turn_index, person, start_s, end_s, text, v): turns of enough words, numbered from 0."""
    enough = turns.filter(F.size(tokens(F.col("text"))) >= cfg.min_turn_words)
    by = Window.partitionBy("session_id").orderBy("turn_index")
    return enough.join(embeddings.select("session_id", "turn_index", "v"), ["session_id", "turn_index"]).select("session_id", (F.row_number().over(by) - 1).alias("pos"), "turn_index", "person", "start_s", "end_s", "text", "v")


def coherence(usable: DataFrame) -> DataFrame:
    """(session_id, turn_index, person, start_s, coherence): similarity to the usable turn before, whoever's it is."""
    by = Window.partitionBy("session_id").orderBy("pos")
    return usable.withColumn("before", F.lag("v").over(by)).filter("before IS NOT NULL").select("session_id", "turn_index", "person", "start_s", dot(F.col("v"), F.col("before")).alias("coherence"))


def _rare_links(usable: DataFrame, cfg: SemanticSettings) -> DataFrame:
    """(session_id, j, i, term): a rare term in turn j whose previous occurrence in the session is turn i."""
    counted = usable.withColumn("n", F.count("*").over(Window.partitionBy("session_id")))
    terms = counted.select("session_id", "pos", "n", F.explode(content_terms(F.col("text"), cfg.anchor_len)).alias("term"))
    same = Window.partitionBy("session_id", "term")
    rare = terms.withColumn("df", F.count("*").over(same)).withColumn("i", F.lag("pos").over(same.orderBy("pos")))
    return rare.filter((F.col("df") <= F.greatest(F.lit(1), F.floor(F.col("n") * cfg.anchor_max_df))) & F.col("i").isNotNull()).select("session_id", F.col("pos").alias("j"), "i", "term", "n")


def _best(linked: DataFrame, usable: DataFrame, cfg: SemanticSettings, extra: list[str]) -> DataFrame:
    pairs = linked.groupBy("session_id", *extra, "j", "i").agg(F.sort_array(F.collect_set("term")).alias("anchors"))
    side = lambda k: usable.select("session_id", F.col("pos").alias(k), F.struct("turn_index", "person", "start_s", "v").alias(f"t{k}"))
    scored = pairs.join(side("j"), ["session_id", "j"]).join(side("i"), ["session_id", "i"]).withColumn("similarity", dot(F.col("tj.v"), F.col("ti.v"))).filter(F.col("similarity") >= cfg.min_similarity)
    rows = scored.select("session_id", *extra, F.col("tj.turn_index").alias("turn_index"), F.col("ti.turn_index").alias("source_index"), (F.col("tj.turn_index") - F.col("ti.turn_index")).alias("lag"), F.col("tj.person").alias("person"), F.col("ti.person").alias("source_person"), F.col("tj.start_s").alias("start_s"), "similarity", "anchors")
    by = Window.partitionBy("session_id", *extra, "turn_index").orderBy(F.desc("similarity"), F.desc("lag"))
    return rows.withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n")


def find_callbacks(usable: DataFrame, cfg: SemanticSettings = SemanticSettings()) -> DataFrame:
    """Turns that take up an earlier, similar turn through a rare term unused since; the best source of each.

    A term is unused in between exactly if the source is its previous occurrence, so a lag over
    each term's occurrences finds the pairs without comparing turns with turns.
    """
    lag = F.col("j") - F.col("i")
    far = lag <= cfg.callback_max_lag if cfg.callback_max_lag else F.lit(True)
    links = _rare_links(usable, cfg).filter((lag >= cfg.callback_min_lag) & far & (F.col("n") >= cfg.callback_min_lag + 2))
    return _best(links, usable, cfg, [])


def callback_sensitivity(usable: DataFrame, cfg: SemanticSettings = SemanticSettings()) -> DataFrame:
    """(session_id, min_lag, n, median_lag): callbacks found under other minimum lags."""
    lag = F.col("j") - F.col("i")
    far = lag <= cfg.callback_max_lag if cfg.callback_max_lag else F.lit(True)
    links = _rare_links(usable, cfg).withColumn("min_lag", F.explode(F.array(*map(F.lit, cfg.sensitivity_lags)))).filter((lag >= F.col("min_lag")) & far & (F.col("n") >= F.col("min_lag") + 2))
    found = _best(links, usable, cfg, ["min_lag"]).groupBy("session_id", "min_lag").agg(F.count("*").alias("n"), F.median("lag").alias("median_lag"))
    grid = usable.select("session_id").distinct().withColumn("min_lag", F.explode(F.array(*map(F.lit, cfg.sensitivity_lags))))
    return grid.join(found, ["session_id", "min_lag"], "left").fillna(0, ["n"])


def segment(vectors: np.ndarray, cfg: SemanticSettings = SemanticSettings()) -> list[int]:
    """Positions where a topic starts, from the depth of the valleys in block similarity."""
    n, w = len(vectors), cfg.topic_window
    if n < 2 * cfg.topic_min_turns:
        return [0]
    gaps = np.arange(w, n - w)
    if not len(gaps):
        return [0]

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    sums = np.vstack([np.zeros(vectors.shape[1]), np.cumsum(vectors, axis=0)])
    left, right = unit((sums[gaps] - sums[gaps - w]) / w), unit((sums[gaps + w] - sums[gaps]) / w)
    score = (left * right).sum(axis=1)
    depth = np.zeros(len(score))
    for k in range(len(score)):
        a = k
        while a > 0 and score[a - 1] >= score[a]:
            a -= 1
        b = k
        while b < len(score) - 1 and score[b + 1] >= score[b]:
            b += 1
        depth[k] = score[a] + score[b] - 2 * score[k]
    positive = depth[depth > 0]
    if not len(positive):
        return [0]
    deep = gaps[(depth > 0) & (depth >= np.percentile(positive, 100 * cfg.topic_percentile))]
    starts = [0]
    for at in deep.tolist():
        if len(starts) == 1 or at - starts[-1] >= cfg.topic_min_turns:
            starts.append(at)
    return starts


def segment_topics(usable: DataFrame, cfg: SemanticSettings = SemanticSettings()) -> DataFrame:
    """(session_id, topic, first_pos, last_pos, start_s, end_s, person): topics in order, with the person who starts each."""

    def topics(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        starts = segment(np.stack(pdf["v"].map(lambda v: np.asarray(v, float)).to_list()), cfg)
        ends = [*(s - 1 for s in starts[1:]), len(pdf) - 1]
        rows = pdf.reset_index(drop=True)
        return pd.DataFrame({"session_id": rows["session_id"].iloc[0], "topic": range(len(starts)), "first_pos": starts, "last_pos": ends, "start_s": rows["start_s"].iloc[starts].to_numpy(), "end_s": rows["end_s"].iloc[ends].to_numpy(), "person": rows["person"].iloc[starts].to_numpy()})

    return usable.select("session_id", "pos", "person", "start_s", "end_s", "v").groupBy("session_id").applyInPandas(topics, "session_id string, topic int, first_pos int, last_pos int, start_s double, end_s double, person string")


def describe_topics(topics: DataFrame, usable: DataFrame, k: int = 3, cfg: SemanticSettings = SemanticSettings()) -> DataFrame:
    """(session_id, topic, label): the k words of a topic that count most there and least elsewhere."""
    spans = topics.select("session_id", "topic", F.explode(F.sequence("first_pos", "last_pos")).alias("pos"))
    words = usable.join(spans, ["session_id", "pos"]).select("session_id", "topic", "pos", F.posexplode(content_words(F.col("text"), cfg.anchor_len)).alias("at", "term"))
    counts = words.groupBy("session_id", "topic", "term").agg(F.count("*").alias("tf"), F.min(F.struct("pos", "at")).alias("seen"))
    n = topics.groupBy("session_id").agg(F.count("*").alias("n"))
    weighed = counts.withColumn("spread", F.count("*").over(Window.partitionBy("session_id", "term"))).join(n, "session_id").withColumn("weight", F.col("tf") * F.log(F.col("n") / F.col("spread") + 1))
    top = weighed.withColumn("r", F.row_number().over(Window.partitionBy("session_id", "topic").orderBy(F.desc("weight"), "seen"))).filter(F.col("r") <= k)
    return top.groupBy("session_id", "topic").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]), ", ").alias("label"))


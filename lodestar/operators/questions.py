"""Q16. Question trees: depth-first expansion with one expansion for each question, as joins and rounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.graph import settled
from lodestar.plans.dialect import Duck, operator


def question_key(question: Column) -> Column:
    """Lower case, without punctuation, single spaces."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(question)), r"[^\w\s]", ""), r"\s+", " ")


def question_forest(seeds: DataFrame, edges: DataFrame, depth: int = 5, keep_duplicates: bool = True) -> DataFrame:
    """(path, depth, parent, question, is_duplicate): the trees of ``seeds`` (place, question) over ``edges`` (parent, place, question), in depth-first order.

    A question is asked on once: at its first place in depth-first order over all seeds, up to ``depth`` levels
    below them. Later places are flagged as duplicates (or left out) and not asked on. path holds the places from the seed
    down, so sorting by it gives the depth-first order; what follows a question does not depend on its spelling.

    All paths are laid out first, none with a question twice. Then rounds decide: a path whose parent was asked on counts; it is
    asked on if every earlier path to the same question is known not to count; it is a duplicate if an earlier one is
    asked on; and what lies below a duplicate does not count. The earliest open path is decided in
    each round, and with it usually all of its level. Null questions are no questions.
    """
    asked = edges.select(question_key(F.col("parent")).alias("of"), F.col("place").cast("bigint").alias("place"), F.col("question").alias("said"), question_key(F.col("question")).alias("key")).filter("of IS NOT NULL AND key IS NOT NULL")
    asked = settled(asked.groupBy("of", "place").agg(F.min(F.struct("key", "said")).alias("q")).select("of", "place", "q.key", "q.said"))
    none = F.array().cast("array<string>")
    level = seeds.filter("question IS NOT NULL").select(F.array(F.col("place").cast("bigint")).alias("path"), question_key(F.col("question")).alias("key"), F.col("question").alias("said"), none.alias("above"))
    levels = []
    for d in range(1, depth + 1):
        level = level.filter(~F.array_contains("above", F.col("key"))) if d > 1 else level
        below = level.select(F.col("path").alias("up"), F.col("key").alias("of"), F.col("said").alias("parent"), (F.concat("above", F.array("key")) if d > 1 else F.col("above")).alias("above"))
        level = settled(below.join(asked, "of").select(F.concat("up", F.array("place")).alias("path"), "up", "key", "said", "parent", "above", F.lit(d).cast("bigint").alias("depth")))
        levels.append(level)
    paths = settled(reduce(DataFrame.unionByName, levels).select("path", "up", "key", "said", "parent", "depth"))
    # state: null is open, else asked, duplicate or dead
    state = settled(paths.select("path", "up", "key", F.lit(None).cast("string").alias("state"), (F.col("depth") == 1).alias("counts")))
    while not state.filter("state IS NULL").isEmpty():
        # a path is ruled by its parent, then by the earlier paths to its question
        up = state.filter("state IS NOT NULL").select(F.col("path").alias("p"), F.col("state").alias("up_state"))
        ruled = state.join(up, F.col("up") == F.col("p"), "left").withColumn("counts", F.col("counts") | F.coalesce(F.col("up_state") == "asked", F.lit(False)))
        ruled = ruled.withColumn("state", F.when(F.col("state").isNotNull(), F.col("state")).when(F.col("up_state").isin("duplicate", "dead"), F.lit("dead")))
        ruled = settled(ruled.select("path", "up", "key", "state", "counts"))
        firsts = ruled.filter("state IS NULL OR state = 'asked'").groupBy("key").agg(F.min(F.struct("path", "counts")).alias("f")).select(F.col("key").alias("k"), F.col("f.path").alias("first"), F.col("f.counts").alias("first_counts"))
        joined = ruled.join(firsts, F.col("key") == F.col("k"), "left")
        decided = F.when(F.col("state").isNotNull(), F.col("state")).when(~F.col("counts") | ~F.col("first_counts"), F.lit(None)).when(F.col("path") == F.col("first"), F.lit("asked")).otherwise(F.lit("duplicate"))
        state = settled(joined.select("path", "up", "key", decided.alias("state"), "counts"))
    kept = ["asked", "duplicate"] if keep_duplicates else ["asked"]
    known = state.filter(F.col("state").isin(kept)).select(F.col("path").alias("p"), "state")
    out = paths.join(known, F.col("path") == F.col("p"))
    return out.select(F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), "depth", "parent", F.col("said").alias("question"), (F.col("state") == "duplicate").alias("is_duplicate"))


@operator
def questions_in_turn(d: Duck, depth: int = 5) -> str:
    """Q16, oracle of question_forest: all paths in depth-first order, folded one after another."""
    key = lambda c: f"regexp_replace(regexp_replace(trim(lower({c})), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g')"
    return f"""
WITH RECURSIVE asked AS (SELECT {key('parent')} AS up_key, place, min({{'key': {key('question')}, 'said': question}}) AS q FROM @edges@ GROUP BY ALL),
paths AS (
  SELECT [place::BIGINT] AS path, {key('question')} AS key, question AS said, NULL::VARCHAR AS parent, 0::BIGINT AS depth FROM @seeds@
  UNION ALL SELECT list_append(p.path, a.place::BIGINT), a.q.key, a.q.said, p.said, p.depth + 1 FROM paths p JOIN asked a ON a.up_key = p.key WHERE p.depth < {depth}),
folded AS (
  SELECT list_reduce(list({{'kept': []::VARCHAR[], 'dups': []::BIGINT[][], 'path': path, 'key': key}} ORDER BY path),
    lambda s, x: {{'kept': CASE WHEN list_bool_or(list_transform(s.dups, lambda u: x.path[1 : len(u)] = u)) OR list_contains(s.kept, x.key) THEN s.kept ELSE list_append(s.kept, x.key) END,
      'dups': CASE WHEN coalesce(list_bool_or(list_transform(s.dups, lambda u: x.path[1 : len(u)] = u)), false) OR NOT list_contains(s.kept, x.key) THEN s.dups ELSE list_append(s.dups, x.path) END, 'path': x.path, 'key': x.key}},
    {{'kept': []::VARCHAR[], 'dups': []::BIGINT[][], 'path': []::BIGINT[], 'key': ''}}).dups AS dups FROM paths WHERE depth > 0)
SELECT array_to_string(path, '.') AS path, depth, parent, said AS question, list_contains(dups, path) AS is_duplicate
FROM paths, folded WHERE depth > 0 AND NOT coalesce(list_bool_or(list_transform(dups, lambda u: len(u) < len(path) AND path[1 : len(u)] = u)), false)"""

"""Exported version-control text: numbers of lines, kinds of change, commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairoscope.functions import text as T
from kairoscope.session import materialise

#: The character between the fields of an exported commit.
FIELD = "\x1f"
#: Commits up to which their lines are followed by jumps of doubled length.
LEFT = 200_000


def numstat(rows: DataFrame, text: str = "numstat", keys: list[str] | None = None) -> DataFrame:
    """keys, path, additions, deletions; a dash (binary) counts as zero, the last field is the path."""
    line = rows.select(*(keys or []), F.explode(F.split(text, "\n")).alias("line")).where("trim(line) <> ''")
    p = line.withColumn("p", F.split("line", "\t")).where("size(p) >= 3")
    number = lambda i: F.coalesce(F.expr(f"try_cast(p[{i}] AS int)"), F.lit(0))
    return p.select(*(keys or []), F.element_at("p", -1).alias("path"), number(0).alias("additions"), number(1).alias("deletions"))


def name_status(rows: DataFrame, text: str = "name_status", keys: list[str] | None = None) -> DataFrame:
    """keys, path, change_type; renames and copies take the new path."""
    line = rows.select(*(keys or []), F.explode(F.split(text, "\n")).alias("line")).where("trim(line) <> ''")
    p = line.withColumn("p", F.split("line", "\t")).where("size(p) >= 2")
    kind = F.substring(F.col("p")[0], 1, 1)
    return p.select(*(keys or []), F.when(kind.isin("R", "C") & (F.size("p") >= 3), F.expr("try_element_at(p, 3)")).otherwise(F.col("p")[1]).alias("path"), kind.alias("change_type"))


def file_changes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Both texts of each commit joined by path; what only has numbers is a modification."""
    both = name_status(rows, keys=keys).join(numstat(rows, keys=keys), [*keys, "path"], "full_outer")
    return both.select(*keys, "path", F.coalesce("change_type", F.lit("M")).alias("change_type"), F.coalesce("additions", F.lit(0)).alias("additions"), F.coalesce("deletions", F.lit(0)).alias("deletions"))


def commits(rows: DataFrame, text: str = "value") -> DataFrame:
    """sha, parents, author, email, time, subject, body, is_merge of exported lines: sha, parents, name, mail, ISO time, message."""
    p = F.split(F.col(text), FIELD, 6)
    message = T.split_message(p[5])
    parents = F.array_remove(F.split(F.trim(p[1]), " "), "")
    return rows.select(p[0].alias("sha"), parents.alias("parents"), p[2].alias("author"), F.lower(p[3]).alias("email"), F.try_to_timestamp(p[4]).alias("time"), message["subject"].alias("subject"), message["body"].alias("body"), (F.size(parents) > 1).alias("is_merge"))


class History:
    """Ancestors in a table of commits (sha, parents), without a round for each generation.

    First parents make a forest. Each round of a contraction takes about a quarter of its commits out: those that a coin
    chooses and whose parent it does not, so that a child of one goes on to that parent. ``rounds`` have what was taken
    out (sha, to) and by which child it is reached (sha, out), so that all rounds together have a few rows for each
    commit. Of the at most ``most`` commits that are left, ``jumps[k]`` names the one 2**k links behind. What is reached by
    first parents alone goes down the rounds, along the jumps and up again, whatever the depth; further parents of what
    was reached begin the next pass, so that there are as many passes as side branches lie inside one another.
    """

    def __init__(self, commits: DataFrame, most: int = LEFT):
        once = commits.groupBy("sha").agg(F.array_distinct(F.flatten(F.collect_list("parents"))).alias("parents"))
        self.edges = materialise(once.select("sha", F.posexplode("parents").alias("place", "parent")), "parents")
        self.first = self.edges.where("place = 0").select("sha", F.col("parent").alias("to"))
        rows, self.rounds = self.first, []
        while rows.count() > most:
            chosen = lambda c, n=len(self.rounds): F.xxhash64(F.lit(n), c) % 2 == 0
            out = materialise(rows.where(chosen("sha") & ~chosen("to")), "out")
            near = rows.where(chosen("to")).withColumnRenamed("to", "out").join(out.select(F.col("sha").alias("out"), "to"), "out", "left")
            near = materialise(near, "near")
            self.rounds.append((out, near.where("to IS NOT NULL").select("sha", "out")))
            rows = materialise(rows.where(~chosen("sha") & ~chosen("to")).union(near.select("sha", F.coalesce("to", "out"))), "links")
        self.jumps = [materialise(rows, "jumps")]
        while True:
            last = self.jumps[-1]
            twice = materialise(last.join(last.select(F.col("sha").alias("to"), F.col("to").alias("next")), "to").select("sha", F.col("next").alias("to")), "jumps")
            if not twice.take(1):
                break
            self.jumps.append(twice)

    def _line(self, new: DataFrame) -> DataFrame:
        """sha of the given commits and of what first parents lead to from them, once each."""
        begun = []
        for out, _ in self.rounds:
            left = materialise(new.join(out, "sha", "left"), "down")  # what was taken out goes on to its parent
            begun.append(left.where("to IS NOT NULL").select("sha"))
            new = left.select(F.coalesce("to", "sha").alias("sha")).distinct()
        for n, jump in enumerate(self.jumps):
            new = new.union(new.join(jump, "sha").select(F.col("to").alias("sha"))).distinct()
            if n % 6 == 5:
                new = materialise(new, "ancestors")
        found = materialise(new, "ancestors")
        for (_, near), own in zip(reversed(self.rounds), reversed(begun)):
            found = found.union(materialise(near.join(found, "sha", "left_semi").select(F.col("out").alias("sha")).union(own).distinct(), "up"))
        return found

    def ancestors(self, commits: DataFrame) -> DataFrame:
        """sha of the given commits and all before them; parents that are not in the table too."""
        new = materialise(commits.select("sha").distinct(), "ancestors")
        found = None
        while new.take(1):
            if found is None:
                found = new = self._line(new)
            else:
                # A branch off what was found is itself alone; only others are followed.
                ended = materialise(new.join(self.first.join(found.withColumnRenamed("sha", "to"), "to", "left_semi"), "sha", "left_semi"), "ended")
                on = materialise(new.join(ended, "sha", "left_anti"), "on")
                if on.take(1):
                    new = materialise(self._line(on).union(ended).distinct().join(found, "sha", "left_anti"), "ancestors")
                found = found.union(new)
            new = materialise(self.edges.where("place > 0").join(new, "sha", "left_semi").select(F.col("parent").alias("sha")).distinct().join(found, "sha", "left_anti"), "ancestors")
        return new if found is None else found


def commits_since(all_: DataFrame, checkpoint: DataFrame | None) -> DataFrame:
    """Commits that are no ancestor of the checkpoint (column sha); all if there is none or it is unknown."""
    if checkpoint is None:
        return all_
    known = all_.select("sha").join(checkpoint.select("sha"), "sha", "left_semi")
    return all_.join(History(all_).ancestors(known), "sha", "left_anti")


def commit_range(all_: DataFrame, head: str | None, checkpoint: str | None) -> tuple[DataFrame, bool]:
    """The commits that lead to ``head`` and not to ``checkpoint``, and whether the checkpoint was not valid.

    A checkpoint that is no commit, or no ancestor of the head, leaves all that leads to the head. Without a head nothing.
    """
    if head is None:
        return all_.limit(0), False
    history = History(all_)
    reached = history.ancestors(all_.where(F.col("sha") == head).select("sha"))
    if checkpoint is not None:
        last = reached.where(F.col("sha") == checkpoint)
        if last.take(1):
            return all_.join(reached, "sha", "left_semi").join(history.ancestors(last), "sha", "left_anti"), False
    return all_.join(reached, "sha", "left_semi"), checkpoint is not None

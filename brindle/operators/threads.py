"""Comment threads: parents, trees, ranked branches, budgets, rendering.

A thread is an ordered edge list. Depths, subtree sizes and rendering need the whole thread, and a
thread is bounded (a crawl takes a few hundred comments), so those are grouped by story; parents and
counts are joins and windows.
"""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import single_line

#: Branches that count as top, and the most characters of roots and replies in top and other branches.
TOP_BRANCHES, TOP_CAPS, OTHER_CAPS = 5, (900, 500), (400, 250)


def nodes(comments: DataFrame) -> DataFrame:
    """Comments with text, blanks collapsed; of repeated ids in a story the first."""
    first = Window.partitionBy("story_id", "id").orderBy("pos")
    rows = comments.withColumn("text", single_line(F.col("text"))).where("text <> ''")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def parent_links(comments: DataFrame) -> DataFrame:
    """Adds parent_id: the parent if it is a comment of the same story that stayed, else null (a root)."""
    kept = nodes(comments)
    up = kept.select(F.col("story_id").alias("_s"), F.col("id").alias("parent_id"))
    on = (F.col("story_id") == F.col("_s")) & (F.col("parent") == F.col("parent_id")) & (F.col("parent") != F.col("story_id"))
    return kept.join(up, on, "left").drop("_s")


class Forest:
    """One story's tree: cycles are cut at their earliest member, which becomes a root."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values("pos")
        self.ids, self.pos = rows["id"].tolist(), {i: k for k, i in enumerate(rows["id"])}
        self.text, self.author = dict(zip(rows["id"], rows["text"])), dict(zip(rows["id"], rows["author"]))
        self.parent = {i: (int(p) if pd.notna(p) else None) for i, p in zip(rows["id"], rows["parent_id"])}
        self._cut()
        self.children: dict = defaultdict(list)
        for i in self.ids:
            self.children[self.parent[i]].append(i)

    def _cut(self) -> None:
        done: set = set()
        for start in self.ids:
            path, at = {}, start  # ids in order, with their places
            while at is not None and at not in done and at not in path:
                path[at] = len(path)
                at = self.parent[at]
            if at in path:
                ring = list(path)[path[at] :]
                self.parent[min(ring, key=self.pos.__getitem__)] = None
            done.update(path)

    def preorder(self, root: int) -> list[tuple[int, int]]:
        out, stack = [], [(root, 0)]
        while stack:
            i, depth = stack.pop()
            out.append((i, depth))
            stack += [(c, depth + 1) for c in reversed(self.children[i])]
        return out

    def branches(self) -> list[list[tuple[int, int]]]:
        """Branches by size, largest first, ties in order."""
        found = [self.preorder(r) for r in self.children[None]]
        return sorted(found, key=lambda b: (-len(b), self.pos[b[0][0]]))


def branch_table(linked: DataFrame) -> DataFrame:
    """(story_id, id, root, depth, size, rank) with size and rank (from 0) of the comment's branch."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        story, out = rows["story_id"].iloc[0], []
        for rank, branch in enumerate(Forest(rows).branches()):
            out += [(story, i, branch[0][0], depth, len(branch), rank) for i, depth in branch]
        return pd.DataFrame(out, columns=["story_id", "id", "root", "depth", "size", "rank"])

    return linked.select("story_id", "id", "pos", "author", "text", "parent_id").groupBy("story_id").applyInPandas(build, "story_id long, id long, root long, depth int, size int, rank int")


def render_line(comment_id: int, author: str, text: str, depth: int, cap: int) -> str:
    indent = "  " * depth + "> " if depth else ""
    return f"{indent}[comment_id={comment_id} @{author}] {text[:cap]}"


def pack(lengths: list[int], most: int, gap: int = 2) -> list[int]:
    """Positions of branches taken in order: each that still fits, with a gap between; one that doesn't is skipped."""
    used, kept = 0, []
    for k, n in enumerate(lengths):
        need = n + (gap if kept else 0)
        if used + need <= most:
            kept.append(k)
            used += need
    return kept


def render_threads(linked: DataFrame, most: int) -> DataFrame:
    """(story_id, text, included, dropped): whole branches within a budget of characters; ids as lists."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        forest = Forest(rows)
        branches = forest.branches()
        texts = []
        for rank, branch in enumerate(branches):
            caps = TOP_CAPS if rank < TOP_BRANCHES else OTHER_CAPS
            texts.append("\n".join(render_line(i, forest.author[i], forest.text[i], d, caps[d > 0]) for i, d in branch))
        kept = pack([len(t) for t in texts], most)
        included = [i for k in kept for i, _ in branches[k]]
        taken = set(included)
        dropped = [i for i in forest.ids if i not in taken]
        return pd.DataFrame({"story_id": [rows["story_id"].iloc[0]], "text": ["\n\n".join(texts[k] for k in kept)], "included": [included], "dropped": [dropped]})

    schema = "story_id long, text string, included array<long>, dropped array<long>"
    return linked.select("story_id", "id", "pos", "author", "text", "parent_id").groupBy("story_id").applyInPandas(build, schema)


def packed(lengths: Column, most: int, gap: int = 2) -> Column:
    """pack() as a Column: 1-based positions of the taken elements of an array of lengths."""
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"), F.lit(1).alias("i"))

    def step(acc: Column, n: Column) -> Column:
        used = acc["used"] + n + F.when(F.size(acc["kept"]) > 0, gap).otherwise(0)
        fits = used <= most
        return F.struct(
            F.when(fits, used).otherwise(acc["used"]).cast("long").alias("used"),
            F.when(fits, F.concat(acc["kept"], F.array(acc["i"]))).otherwise(acc["kept"]).alias("kept"),
            (acc["i"] + 1).alias("i"),
        )

    return F.aggregate(lengths, zero, step, lambda acc: acc["kept"])


def crawl(comments: DataFrame, max_depth: int, max_count: int, seen: DataFrame | None = None) -> DataFrame:
    """(story_id, id, depth, emitted): comments in breadth-first order from the roots, at depth 1.

    Queue and emitted comments together stay within max_count; a comment without text isn't emitted but its
    replies are; replies seen before at their depth (seen: story_id, depth, id) are skipped, roots never.
    One story at a time, since the order of the queue decides; a story's comments are bounded.
    """
    rows = comments.select("story_id", "id", "parent", "pos", "text")
    known = seen.select("story_id", "depth", "id") if seen is not None else None

    def walk(mine: pd.DataFrame, old: set) -> pd.DataFrame:
        story = mine["story_id"].iloc[0]
        mine = mine.sort_values("pos").drop_duplicates("id")
        kids: dict = defaultdict(list)
        for i, p in zip(mine["id"], mine["parent"]):
            kids[p].append(i)
        text = dict(zip(mine["id"], mine["text"]))
        queue = deque((i, 1) for i in kids[story])
        visited, out, emitted = set(i for i, _ in queue), [], 0
        while queue and emitted < max_count:
            i, depth = queue.popleft()
            shown = bool((text[i] or "").strip())
            emitted += shown
            out.append((story, i, depth, shown))
            if depth < max_depth:
                for child in kids[i]:
                    if emitted + len(queue) >= max_count:
                        break
                    if child not in visited and (depth + 1, child) not in old:
                        visited.add(child)
                        queue.append((child, depth + 1))
        return pd.DataFrame(out, columns=["story_id", "id", "depth", "emitted"])

    schema = "story_id long, id long, depth int, emitted boolean"
    if known is None:
        return rows.groupBy("story_id").applyInPandas(lambda mine: walk(mine, set()), schema)
    empty = pd.DataFrame({"story_id": [], "id": [], "depth": [], "emitted": []})
    both = lambda mine, old: walk(mine, set(zip(old["depth"], old["id"]))) if len(mine) else empty
    return rows.groupBy("story_id").cogroup(known.groupBy("story_id")).applyInPandas(both, schema)

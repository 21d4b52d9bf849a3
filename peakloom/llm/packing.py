"""Best-fit packing by a linear grouping scheme.

Documents become token ids with a closing id; those over the capacity are cut, the rest of the division first. Pieces
of the full capacity are sequences of their own. The others are planned from the histogram of their lengths, which has
fewer than capacity rows whatever the corpus holds:
1. Large pieces, longest first, fall into groups of equal number; lengths are rounded up to the longest of the group.
2. Few sizes are left, so full configurations are found by reachability over sizes (the fullest set beside the largest
   size that remains) and used as often as the groups' counts allow.
3. Actual pieces take the places of their group's rounded ones by rank, which leaves gaps of known sizes.
4. Small pieces go into the gaps, longest first, each length into the smallest gap that takes it (best fit), by counts.
What is small is settled by planning with each share in SMALL and taking the plan with the fewest sequences. The plan is
a list of ranges of ranks; pieces find their place by their rank among pieces of equal length. Ranks are counted in
salted parts, so that no length's pieces meet in one task; nothing but the histogram reaches the driver.

Cases: a null text is the empty one: one piece that holds the closing id. A null id stays null, repeated rows are
packed as often as they occur, other columns are not read, an empty table gives an empty result. Very long runs of white
space are encoded like any other text.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakloom.llm.common import cut, in_slices, light, map_arrow, text_of
from peakloom.llm.tokens import _ODD, byte_letters, default_tokenizer

GROUPS = 1024
#: Pieces up to one of these shares of the capacity are small.
SMALL = (8, 4, 3)
#: Rows of equal length that are ranked in one task, and the fewest parts of a length.
RANKED, PARTS = 100_000, 16
#: A run of white space, for which the fast encoder's regular expressions would take a level of their stack a character.
_RUN = re.compile(r"\s{5000}")


class Encoder:
    """Ids as the tokenizers library gives them for a byte-level BPE file, whose ids are the ranks of its merges: such
    a vocabulary is encoded by tiktoken, several times as fast, and texts with characters or special strings that the
    two might treat apart, or with very long runs of white space, go to the library itself."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.path = path
        spec = json.load(open(path, encoding="utf-8"))
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.special = tuple(t["content"] for t in spec["added_tokens"])
        ranks = {bytes(byte_of[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in self.special}
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def library(self):
        """The library's own tokenizer, made when a text first needs it."""
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        made.no_truncation()
        made.no_padding()
        return made

    def ids(self, text: str) -> np.ndarray:
        if _ODD.search(text) or any(s in text for s in self.special) or _RUN.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, capacity: int, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", closing: int = 0) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32."""
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in in_slices(batches):
            at: list[int] = []
            out: list[tuple[int, int, int, int]] = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(own.ids(text), np.array([closing], "<u4")).astype("<u4")
                edges = sorted({0, *range(len(ids), 0, -capacity)})
                for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    at.append(k)
                    out.append((i, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(rows, make, schema)


def _configurations(groups: list[tuple[int, int]], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """For groups (size, count), largest size first: (how often, {group: how many in a sequence}), which uses all."""
    left = [n for _, n in groups]
    plan = []
    for top in range(len(groups)):
        while left[top]:
            room = capacity - groups[top][0]
            left[top] -= 1
            # reach[i]: bit s is set if sizes of the open groups so far can add up to s
            open_groups = [g for g in range(top, len(groups)) if left[g] and groups[g][0] <= room]
            mask, reach = (1 << room + 1) - 1, [1]
            for g in open_groups:
                now, size = reach[-1], groups[g][0]
                for _ in range(min(left[g], room // size)):
                    more = now | now << size & mask
                    if more == now:
                        break
                    now = more
                reach.append(now)
                if now >> room:
                    break
            total = reach[-1].bit_length() - 1
            use: dict[int, int] = defaultdict(int)
            for i in range(len(reach) - 1, 0, -1):
                g = open_groups[i - 1]
                while total and not reach[i - 1] >> total & 1:
                    use[g] += 1
                    total -= groups[g][0]
            left[top] += 1
            use[top] += 1
            times = min(left[g] // k for g, k in use.items())
            for g, k in use.items():
                left[g] -= k * times
            plan.append((times, dict(use)))
    return plan


def plan_large(hist: dict[int, int], capacity: int, n_groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, sequences): pieces of the length with ranks from first to end go,
    one each in turn, to so many sequences from the first one on. hist: pieces by length, all of them large."""
    lengths = sorted(hist, reverse=True)
    total = sum(hist.values())
    size = max(1, -(-total // n_groups))
    groups: list[tuple[int, int]] = []
    place, at = [], 0  # the order: longest first; each length owns a range of it
    for n in lengths:
        place.append((at, at + hist[n], n))
        at += hist[n]
    k = 0
    for start in range(0, total, size):
        while place[k][1] <= start:
            k += 1
        groups.append((place[k][2], min(size, total - start)))
    ranges, taken, bins = [], [0] * len(groups), 0
    for times, use in _configurations(groups, capacity):
        for g, each in use.items():
            for _ in range(each):
                first = g * size + taken[g]
                ranges.append((first, first + times, bins, times))
                taken[g] += times
        bins += times
    ranges.sort()
    out, k = [], 0
    for first, end, bin0, _ in ranges:
        while place[k][1] <= first:
            k += 1
        j, at = k, first
        while at < end:
            upto = min(end, place[j][1])
            out.append((place[j][2], at - place[j][0], upto - place[j][0], bin0 + at - first, upto - at))
            at, j = upto, j + 1
    return out


def plan_small(hist: dict[int, int], gaps: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """As plan_large() for small pieces and sequences that are numbered by their gap, smallest gap first; and how many
    new sequences it opens, numbered after those."""
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)
    at = 0
    for g in sorted(gaps):
        open_[g].append((at, gaps[g]))
        at += gaps[g]
    known = at
    out = []
    for n in sorted(hist, reverse=True):
        rank, left = 0, hist[n]
        while left:
            fit = min((g for g, x in open_.items() if g >= n and x), default=None)
            if fit is None:
                each = capacity // n
                new = -(-left // each)
                open_[capacity].append((at, new))
                at, fit = at + new, capacity
            bin0, have = open_[fit].pop()
            use = min(have, left)
            if use < have:
                open_[fit].append((bin0 + use, have - use))
            out.append((n, rank, rank + use, bin0, use))
            open_[fit - n].append((bin0, use))
            rank, left = rank + use, left - use
    return out, at - known


def _gaps(ranges: list[tuple[int, int, int, int, int]], capacity: int) -> list[tuple[int, int, int]]:
    """(gap, first sequence, sequences) of the runs of sequences between the ends of plan_large()'s ranges, by gap."""
    if not ranges:
        return []
    edges = np.unique([e for *_, bin0, n in ranges for e in (bin0, bin0 + n)])
    step = np.zeros(len(edges), np.int64)
    for length, _, _, bin0, n in ranges:
        step[np.searchsorted(edges, bin0)] += length
        step[np.searchsorted(edges, bin0 + n)] -= length
    fill = np.cumsum(step)
    return sorted((capacity - int(f), int(a), int(b - a)) for a, b, f in zip(edges, edges[1:], fill, strict=False))


def plan(hist: dict[int, int], capacity: int, shares: tuple[int, ...] = SMALL, n_groups: int = GROUPS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """plan_large()'s and plan_small()'s ranges for a histogram of lengths below capacity, all with sequences numbered
    from 0, and how many sequences there are: the best over the shares up to which pieces are small."""
    best: tuple[list, int] | None = None
    for share in shares:
        edge = capacity // share
        large = plan_large({n: c for n, c in hist.items() if n > edge}, capacity, n_groups)
        runs = _gaps(large, capacity)
        known, totals = sum(n for *_, n in runs), defaultdict(int)
        for gap, _, n in runs:
            totals[gap] += n
        small, new = plan_small({n: c for n, c in hist.items() if n <= edge}, totals, capacity)
        if best is None or known + new < best[1]:
            # small pieces' sequences are numbered by gap; here they get back the number that large pieces have
            starts = np.append(0, np.cumsum([n for *_, n in runs])).astype(np.int64)
            own = []
            for length, first, end, number, n in small:
                at = number
                while at < number + n:
                    if at >= known:
                        upto, to = number + n, at
                    else:
                        k = int(np.searchsorted(starts, at, "right")) - 1
                        upto, to = min(number + n, int(starts[k + 1])), runs[k][1] + at - int(starts[k])
                    own.append((length, first + at - number, first + upto - number, to, upto - at))
                    at = upto
            best = large + own, known + new
    return best or ([], 0)


def ranked(rows: DataFrame, key: str, unique: str, counts: dict[int, int], name: str = "rank") -> DataFrame:
    """Adds the rank, from 0, of each row among those of equal key; any order, but fixed. counts: the rows of each key.
    Rows are counted in salted parts of at most about RANKED rows, of which the sums give where each part starts."""
    spark = rows.sparkSession
    parts = spark.createDataFrame([(int(k), max(PARTS, -(-n // RANKED))) for k, n in counts.items()], "__key long, __parts long")
    rows = rows.join(F.broadcast(parts), F.col(key) == F.col("__key")).withColumn("__salt", F.pmod(F.xxhash64(unique), F.col("__parts"))).drop("__key", "__parts")
    inside = F.row_number().over(Window.partitionBy(key, "__salt").orderBy(unique)) - 1
    upto = F.sum("count").over(Window.partitionBy(key).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy(key, "__salt").count().select(F.col(key).alias("__k"), F.col("__salt").alias("__s"), F.coalesce(upto, F.lit(0)).alias("__from"))
    out = rows.withColumn("__in", inside).join(light(cut(starts)), (F.col(key) == F.col("__k")) & (F.col("__salt") == F.col("__s")))
    return out.withColumn(name, F.col("__from") + F.col("__in")).drop("__salt", "__k", "__s", "__from", "__in")


def _placed(rows: DataFrame, key: str, ranges: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Joins rows that have key and rank with a plan's ranges; gives the sequence's number as bin. The ranges are a bounded
    number, by the capacity and the groups."""
    table = rows.sparkSession.createDataFrame([tuple(map(int, p)) for p in ranges], "__len long, __a long, __b long, __bin long, __n long")
    on = (F.col(key) == F.col("__len")) & (F.col("rank") >= F.col("__a")) & (F.col("rank") < F.col("__b"))
    return rows.join(F.broadcast(table), on).withColumn("bin", F.col("__bin") + F.col("rank") - F.col("__a")).drop("__len", "__a", "__b", "__bin", "__n")


def packed(parts: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to rows with a length from 1 to capacity. The broadcast plan and what reaches the
    driver have a few rows for each length, so a bound that depends on the capacity and GROUPS only."""
    rows = cut(parts.withColumn("__row", F.monotonically_increasing_id()))
    hist = {r[0]: r[1] for r in rows.where(F.col("length") < capacity).groupBy("length").count().collect()}
    ranges, _ = plan(hist, capacity)
    placed = _placed(ranked(rows.where(F.col("length") < capacity), "length", "__row", hist), "length", ranges).drop("rank")
    full = rows.where(F.col("length") == capacity).withColumn("bin", -1 - F.col("__row"))
    order = Window.partitionBy("bin").orderBy(F.desc("length"), "__row").rowsBetween(Window.unboundedPreceding, -1)
    return placed.unionByName(full).select(*parts.columns, F.col("bin").alias("sequence_id"), F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long").alias("offset"))


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packed(pieces(docs, capacity, tokenizer, id_col, text_col), capacity)

"""Packing tokenized documents into fixed-length sequences as a cutting-stock problem.

Documents are cut at multiples of the sequence length; what is left over goes into a histogram of
length classes (multiples of ``GRID`` tokens, so its size is fixed). On the driver a linear program
over filling patterns is solved by column generation: the duals price classes and a knapsack dynamic
program finds the best new pattern. The rounded patterns are then dealt to the ranked pieces by
DataFrame joins: a class's pieces are numbered by running counts over input partitions, so a length
that a third of all documents share is spread over many tasks.

Token ids are those of the tokenizer file. Texts whose characters all lie below U+0250 are encoded
by the same vocabulary's rank file, which is several times faster; any other text, and any that holds
an added token such as ``<|endoftext|>``, takes the tokenizer.

Defined results: null or empty text is the end id alone; rows that repeat a doc_id are documents of
their own; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LENGTH = 2048
GRID = 8
END_ID = 1


def encoder(json_path: str, ranks_path: str, pattern: str):
    """text -> little-endian 32-bit ids as bytes, without the end id."""
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(json_path)
    special = [t.content for t in exact.get_added_tokens_decoder().values()]
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> bytes:
        if not text:
            return b""
        plain = max(text) < "ɐ" and not any(t in text for t in special)
        ids = quick.encode_ordinary(text) if plain else exact.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    return encode


def pieces(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, class and, if asked for, document
    (a number of the input's row, so that rows which repeat a doc_id stay apart) and ids."""
    tail = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(json_path, ranks_path, pattern)
        for batch in batches:
            rows = []
            for document, doc_id, text in zip(batch["document"], batch["doc_id"], batch["text"], strict=True):
                ids = encode(text) + tail
                n = len(ids) // 4
                for start in range(0, n, LENGTH):
                    part = ids[4 * start : 4 * (start + LENGTH)]
                    rows.append((document, doc_id, start, len(part) // 4, zlib.crc32(part), n, -(-(len(part) // 4) // GRID), part if keep_ids else None))
            yield pd.DataFrame(rows, columns=["document", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "ids"]).astype({"doc_id": batch["doc_id"].dtype})

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("document"), "doc_id", "text")
    made = numbered.mapInPandas(run, f"document long, doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, class int, ids binary")
    return made if keep_ids else made.drop("document", "ids")


def knapsack(values: np.ndarray, classes: np.ndarray, capacity: int) -> tuple[float, Counter]:
    """The most valuable multiset of classes that fits, by dynamic programming over capacities."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fit = np.searchsorted(classes, c, side="right")
        if fit:
            total = best[c - classes[:fit]] + values[:fit]
            k = int(total.argmax())
            if total[k] > best[c] + 1e-12:
                best[c], took[c] = total[k], k
    pattern, c = Counter(), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[int(took[c])] += 1
            c -= int(classes[took[c]])
    return float(best[capacity]), pattern


def patterns(demand: dict[int, int], capacity: int, steps: int = 20000) -> list[tuple[dict[int, int], int]]:
    """Filling patterns {class: pieces} with how often each is used, covering every class's demand.

    Column generation on min sum(x) with A x >= demand, then rounding down and first-fit-decreasing
    for what is left. At most a few times as many patterns as classes.
    """
    classes = np.array(sorted(k for k, n in demand.items() if n > 0))
    if not len(classes):
        return []
    need = np.array([float(demand[k]) for k in classes])
    m = len(classes)
    columns = np.zeros((m, m))
    np.fill_diagonal(columns, capacity // classes)
    inverse, x, costs = np.diag(1.0 / np.diag(columns)), need / np.diag(columns), np.ones(m)
    for _ in range(steps):
        price = costs @ inverse  # a pattern costs one sequence, a slack nothing
        value, pattern = knapsack(np.maximum(price, 0.0), classes, capacity)
        surplus = int(price.argmin())
        entering, cost = np.zeros(m), 1.0
        if price[surplus] < -1e-9:  # a slack column: the class is over-supplied
            entering[surplus], cost = -1.0, 0.0
            gain = -price[surplus]
        else:
            for k, n in pattern.items():
                entering[k] = n
            gain = value - 1.0
        if gain < 1e-7:
            break
        way = inverse @ entering
        ratio = np.full(m, np.inf)
        up = way > 1e-9
        ratio[up] = x[up] / way[up]
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        x = x - step * way
        x[out] = step
        columns[:, out], costs[out] = entering, cost
        row = inverse[out] / way[out]
        inverse = inverse - np.outer(way, row)
        inverse[out] = row
    return _rounded([*_used(columns, x)], classes, demand, capacity)


def _used(columns: np.ndarray, x: np.ndarray):
    for at in range(columns.shape[1]):
        times = int(np.floor(x[at] + 1e-7))
        if times > 0 and (columns[:, at] >= 0).all():
            yield columns[:, at].round().astype(int), times


def _rounded(used: list, classes: np.ndarray, demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    left, made = {int(k): demand[int(k)] for k in classes}, []
    for column, times in used:
        items = {int(classes[at]): int(column[at]) for at in np.flatnonzero(column)}
        # Never more slots than pieces are left.
        times = min([times, *(left[k] // n for k, n in items.items())])
        if times > 0:
            made.append((items, times))
            for k, n in items.items():
                left[k] -= n * times
    while any(left.values()):  # first fit, largest first; equal patterns are counted together
        items, room = Counter(), capacity
        for k in sorted(left, reverse=True):
            n = min(left[k], room // k)
            if n:
                items[k] = n
                room -= n * k
        times = min(left[k] // n for k, n in items.items())
        made.append((dict(items), times))
        for k, n in items.items():
            left[k] -= n * times
    return made


def pack(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Pieces with their sequence_id and offset; sequences hold at most ``LENGTH`` tokens.

    ``keep_ids``: with the token ids and the row's number too, from which sequences can be built.
    """
    spark = docs.sparkSession
    cutting = written(pieces(docs, json_path, ranks_path, pattern, keep_ids).withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}))
    # Only the pieces' numbers are dealt; ids, if kept, meet their seats once, at the end.
    narrow = cutting.drop("document", "ids")
    counts = narrow.groupBy("class", "part").agg(F.count("*").alias("n"))
    # One row per class: at most LENGTH / GRID.
    demand = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    slots, base = [], 0
    begun: Counter = Counter()
    for items, times in patterns(demand, LENGTH // GRID):
        place = 0
        for k in sorted(items, reverse=True):
            slots.append((k, begun[k], begun[k] + items[k] * times, items[k], base, place))
            begun[k] += items[k] * times
            place += items[k]
        base += times
    dealt = F.broadcast(spark.createDataFrame(slots, "s_class int, since long, until long, each long, base long, place long"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("class").alias("o_class"), F.col("part").alias("o_part"), before.alias("before"))
    ranked = narrow.join(offsets, (F.col("class") == F.col("o_class")) & (F.col("part") == F.col("o_part")))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("class", "part").orderBy("row")) - 1
    at = ranked.withColumn("rank", rank).join(dealt, (F.col("class") == F.col("s_class")) & (F.col("rank") >= F.col("since")) & (F.col("rank") < F.col("until")))
    nth = F.col("rank") - F.col("since")
    seated = at.withColumn("sequence_id", F.col("base") + F.floor(nth / F.col("each"))).withColumn("seat", F.col("place") + nth % F.col("each"))
    inside = Window.partitionBy("sequence_id").orderBy("seat").rowsBetween(Window.unboundedPreceding, -1)
    out = seated.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long").alias("sequence_id"),
        F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"), "row",
    )
    return (out.join(cutting.select("row", "document", "ids"), "row") if keep_ids else out).drop("row")

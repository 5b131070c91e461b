"""Filling fixed-capacity containers with documents (problem 7).

Best-two-fit: a container is filled greedily with the longest piece that still
fits; if a gap stays, its smallest piece is put back and replaced by two unpacked
ones that fill the widened gap more tightly. A document is split only if it alone
exceeds the capacity: into full pieces and a rest that is packed like any other.

Size: pieces are packed in blocks of about BLOCK documents, chosen by a hash of
their ids and places in the table (so copies of an id are spread), each block in one task. A block loses at most the gap of its
last container, so the loss does not grow with the corpus.

Edge cases: null and empty texts have no tokens and lie in the first container of
their block; equal sizes are taken in the order of ids; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from figmill.llm.tokens import VOCABULARIES, sizes
from figmill.session import cut

#: Documents of a block; sets memory and time of a packing task.
BLOCK = 40_000


class _Stock:
    """Unpacked pieces by size, with the sizes that are left as the bits of a number."""

    def __init__(self, items: list[tuple[int, object]]):
        self.by: dict[int, list] = defaultdict(list)
        for size, key in sorted(items, reverse=True):
            self.by[size].append(key)
        self.bits = 0
        for s in self.by:
            self.bits |= 1 << s

    def best(self, room: int) -> int:
        """The largest size up to ``room``, 0 if there is none."""
        return (self.bits & ((1 << (room + 1)) - 1)).bit_length() - 1 if room > 0 and self.bits else 0

    def take(self, size: int) -> tuple[int, object]:
        key = self.by[size].pop()
        if not self.by[size]:
            self.bits ^= 1 << size
        return size, key

    def back(self, size: int, key: object) -> None:
        self.by[size].append(key)
        self.bits |= 1 << size

    def pair(self, room: int, more_than: int) -> tuple[int, int] | None:
        """Two sizes whose sum is largest among those up to ``room`` and over ``more_than``."""
        best, found = more_than, None
        a = self.best(room - 1)
        while a > 0 and 2 * a > best:
            b = self.best(min(a, room - a))
            if b == a and len(self.by[a]) < 2:
                b = self.best(a - 1)
            if b > 0 and a + b > best:
                best, found = a + b, (a, b)
                if best == room:
                    break
            a = self.best(a - 1)
        return found


def best_two_fit(items: list[tuple[int, object]], capacity: int) -> list[list[tuple[int, object]]]:
    """Containers of (size, key); every size is from 1 to ``capacity``."""
    stock, out = _Stock(items), []
    while stock.bits:
        one, room = [], capacity
        while (s := stock.best(room)) > 0:
            one.append(stock.take(s))
            room -= s
        if room and len(one) > 1:
            size, key = one[-1]
            if two := stock.pair(room + size, size):
                one.pop()
                one += [stock.take(two[0]), stock.take(two[1])]
                stock.back(size, key)
        out.append(one)
    return out


PACKED = "spec_id int, doc_id long, piece_no int, container string, tokens int, capacity int"


def pack(docs: DataFrame, specs: DataFrame, folder: str = VOCABULARIES) -> DataFrame:
    """spec_id, doc_id, piece_no, container, tokens, capacity: every piece of every document in one container of each kind."""
    rows = [(r.spec_id, r.tokenizer, r.capacity) for r in specs.select("spec_id", "tokenizer", "capacity").collect() if r.tokenizer and r.capacity]
    if not rows:
        return docs.sparkSession.createDataFrame([], PACKED)
    sized = cut(sizes(docs, sorted({t for _, t, _ in rows}), folder))
    blocks = max(1, -(-sized.count() // BLOCK))
    kinds = F.array(*(F.struct(F.lit(s).cast("int").alias("spec_id"), F.lit(c).cast("int").alias("capacity"), F.col(t).alias("tokens")) for s, t, c in rows))
    work = sized.select("doc_id", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id() % BLOCK), F.lit(blocks)).cast("int").alias("block"), F.explode(kinds).alias("k")).select("doc_id", "block", "k.*")
    return work.groupBy("spec_id", "block").applyInPandas(_pack_block, PACKED)


def _pack_block(pdf: pd.DataFrame) -> pd.DataFrame:
    spec, block, capacity = int(pdf.spec_id.iloc[0]), int(pdf.block.iloc[0]), int(pdf.capacity.iloc[0])
    rows, items, no = [], [], 0
    name = f"{spec}-{block}-"
    for k, (doc, n) in enumerate(zip(pdf.doc_id.tolist(), pdf.tokens.tolist())):
        whole, rest = divmod(n, capacity)
        if rest == 0 and whole:
            whole, rest = whole - 1, capacity
        for i in range(whole):
            rows.append((doc, i, f"{name}{no}", capacity))
            no += 1
        if n:
            items.append((rest, (doc, whole, k)))
    for one in best_two_fit(items, capacity):
        rows += [(doc, piece, f"{name}{no}", size) for size, (doc, piece, _) in one]
        no += 1
    rows += [(doc, 0, f"{name}0", 0) for doc, n in zip(pdf.doc_id.tolist(), pdf.tokens.tolist()) if n == 0]
    out = pd.DataFrame(rows, columns=["doc_id", "piece_no", "container", "tokens"])
    return out.assign(spec_id=spec, capacity=capacity)[["spec_id", "doc_id", "piece_no", "container", "tokens", "capacity"]]


def summary(packed: DataFrame) -> DataFrame:
    """spec_id, capacity, containers, tokens, fill: how full the containers of each kind are."""
    per = packed.groupBy("spec_id", "capacity").agg(F.countDistinct(F.when(F.col("tokens") > 0, F.col("container"))).alias("containers"), F.sum(F.col("tokens").cast("long")).alias("tokens"))
    return per.withColumn("fill", F.round(F.try_divide(F.col("tokens").cast("double"), F.col("containers") * F.col("capacity")), 6))

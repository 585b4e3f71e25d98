"""Best-fit packing of tokenised documents into fixed-length sequences with a grouping genetic algorithm.

Chromosomes are partitions of a shard's pieces into sequences. Crossover puts whole well-filled sequences of one parent into the other,
takes out the sequences that held the same pieces, and best-fits what they displaced. Each shard evolves on several islands, Spark
tasks of their own, between which elites migrate.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .scratch import save
from .tokens import SPACE, slices, span_hashes, utf8

CACHE = 600_000
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[np.frombuffer(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)] = True
_SPECIAL = ("<|startoftext|>", "<|endoftext|>")


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}


def cuts_at_words(settings: dict) -> bool:
    """Whether a vocabulary file's settings are those that ``WordIds`` makes use of."""
    kinds = [n["type"] for n in (settings.get("normalizer") or {}).get("normalizers", [])]
    steps = (settings.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = steps[0].get("pattern", {}).get("Regex", "") if steps else ""
    special = tuple(t["content"] for t in settings.get("added_tokens") or ())
    words = pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and [p["type"] for p in steps] == ["Split", "ByteLevel"] and not steps[1].get("add_prefix_space")
    return kinds == ["NFC", "Replace", "Lowercase"] and words and special == _SPECIAL


class WordIds:
    """Ids of whole texts by a word-level BPE vocabulary file, from the ids of their distinct fragments.

    The vocabulary's own pre-tokeniser never joins across white space, nor a letter with a mark other than an apostrophe, so texts
    are cut there, and each distinct fragment is encoded once. Texts with a special token's string go to the tokeniser whole, and so do
    all texts where the vocabulary's settings aren't those (lower case, words, single digits, marks).
    """

    def __init__(self, path: str):
        self.tokenizer, self.table, self.known = Tokenizer.from_file(path), byte_letters(), {}
        self.by_fragment = cuts_at_words(json.loads(self.tokenizer.to_str()))

    def fragment(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8", "replace")
        if text.isalpha() and max(text) < "Ā":
            ids = [t.id for t in self.tokenizer.model.tokenize(text.lower().encode().decode("latin-1").translate(self.table))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, np.uint32).tobytes()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each text ended by id 0, and the texts' offsets among them."""
        if not self.by_fragment:
            own = [np.array([*self.tokenizer.encode(text or "", add_special_tokens=False).ids, 0], np.uint32) for text in column.to_pylist()]
            return np.concatenate(own) if own else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in own], dtype=np.int64)])
        data, offsets = utf8(column)
        inside = ~SPACE[data]
        letter = _LETTER[data]
        if len(data) > 1:  # the second byte of a letter from U+00C0 to U+00FF, without the two signs there
            letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
            first = _LETTER[data[1:]].copy()
            first[:-1] |= (data[1:-1] == 0xC3) & (data[2:] >= 0x80) & (data[2:] != 0x97) & (data[2:] != 0xB7)
            cut = (letter[:-1] & _MARK[data[1:]]) | (_MARK[data[:-1]] & first)
        else:
            cut = np.zeros(0, bool)
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | cut
        bounds = np.zeros(len(data) + 1, bool)
        bounds[offsets] = True
        begins |= inside & bounds[:-1]
        start = np.flatnonzero(begins)
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | cut
        ends |= inside & bounds[1:]
        end = np.flatnonzero(ends) + 1
        doc = np.searchsorted(offsets, start, "right") - 1
        names, where, inverse = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.known) > CACHE:
            self.known.clear()
        raw, found = data.tobytes(), []
        for name, s, e in zip(names.tolist(), start[where].tolist(), end[where].tolist(), strict=True):
            ids = self.known.get(name)
            if ids is None:
                ids = self.known[name] = self.fragment(raw[s:e])
            found.append(ids)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        n = size[inverse]
        total = np.bincount(doc, weights=n, minlength=len(column)).astype(np.int64) + 1
        begin = (np.cumsum(size) - size)[inverse]
        to = np.cumsum(n) - n + doc  # each text before has its end mark
        out = np.zeros(int(total.sum()), np.uint32)
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(to, n) + step] = flat[np.repeat(begin, n) + step]
        return self.whole(column, raw, out, np.concatenate([[0], np.cumsum(total)]))

    def whole(self, column: pa.Array, raw: bytes, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not any(s.encode() in raw for s in _SPECIAL):
            return ids, first
        parts = [ids[s:e] for s, e in zip(first[:-1], first[1:], strict=True)]
        for k, text in enumerate(column.to_pylist()):
            if text and any(s in text for s in _SPECIAL):
                parts[k] = np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, 0], np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def pieces(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids, ended by id 0, cut every ``capacity`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordIds(path)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids, first = encoder.encode(part.column("text"))
                size = np.diff(first)
                n = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(size[row] - start, capacity)
                raw, at = memoryview(ids.astype("<u4")).cast("B"), (first[row] + start)
                crc = [zlib.crc32(raw[4 * s : 4 * (s + k)]) for s, k in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(items: list[int], length: list[int], room: list[tuple[int, int]], capacity: int, bins: list[int], new: int) -> int:
    """Puts the items, in order, where the least room that suffices is left; room: sorted (left, bin). Returns the next new bin."""
    for i in items:
        need = length[i]
        k = bisect_left(room, (need, -1))
        if k < len(room):
            left, b = room.pop(k)
        else:
            left, b, new = capacity, new, new + 1
        bins[i] = b
        if left > need:
            insort(room, (left - need, b))
    return new


def fills(bins: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.bincount(bins, weights=length).astype(np.int64)


def fitness(bins: np.ndarray, length: np.ndarray, capacity: int) -> float:
    """Mean squared fill of the used sequences: higher for fewer and fuller ones."""
    full = fills(bins, length)
    full = full[full > 0] / capacity
    return float((full * full).mean())


def crossover(a: np.ndarray, b: np.ndarray, length: np.ndarray, sizes: list[int], capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of ``a`` with some of the best-filled sequences of ``b``."""
    full = fills(b, length)
    keys = full + rng.uniform(0, capacity / 50, len(full))
    chosen = np.zeros(len(full), bool)
    chosen[np.argsort(-keys)[: max(1, int(len(full) * rng.uniform(0.1, 0.4)))]] = True
    moved = chosen[b]
    spoiled = np.zeros(a.max() + 1, bool)
    spoiled[a[moved]] = True
    out = np.flatnonzero(spoiled[a] & ~moved)
    kept = ~spoiled[a] & ~moved
    child = np.full(len(a), -1)
    child[kept] = np.unique(a[kept], return_inverse=True)[1]
    n = int(child.max()) + 1
    child[moved] = n + np.unique(b[moved], return_inverse=True)[1]
    n = int(child.max()) + 1
    room = capacity - np.bincount(child[child >= 0], weights=length[child >= 0], minlength=n).astype(np.int64)
    room = sorted((int(r), k) for k, r in enumerate(room) if r > 0)
    order = out[np.argsort(-length[out] + rng.uniform(0, 3, len(out)), kind="stable")]
    bins = child.tolist()
    best_fit(order.tolist(), sizes, room, capacity, bins, n)
    return np.array(bins)


def evolve(length: np.ndarray, guests: list[np.ndarray], capacity: int, rng: np.random.Generator, population: int = 4, generations: int = 10) -> np.ndarray:
    """The best partition after some generations; guests join the first population of best fits in nearly falling order."""
    sizes, everyone = length.tolist(), list(guests)
    while len(everyone) < population:
        noise = rng.uniform(0, 40 * len(everyone) + 1e-9, len(length))
        bins = [0] * len(length)
        best_fit(np.argsort(-length + noise, kind="stable").tolist(), sizes, [], capacity, bins, 0)
        everyone.append(np.array(bins))
    scored = sorted(((fitness(x, length, capacity), k, x) for k, x in enumerate(everyone)), reverse=True)
    for g in range(generations):
        a, b = (scored[int(i)][2] for i in rng.choice(len(scored), 2, replace=False))
        for child in (crossover(a, b, length, sizes, capacity, rng), crossover(b, a, length, sizes, capacity, rng)):
            scored.append((fitness(child, length, capacity), population + g, child))
        scored = sorted(scored, key=lambda x: x[:2], reverse=True)[:population]
    return scored[0][2]


_FIELDS = ("doc_id", "piece", "start", "length", "ids_crc32")


def pack_rest(rest: DataFrame, capacity: int, shard_rows: int, islands: int, epochs: int, seed: int) -> DataFrame:
    """(shard, items, elite): pieces shorter than a sequence, by shards, with the best partition that the shard's islands found."""
    shards = max(1, -(-rest.count() // shard_rows))
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), *_FIELDS, F.monotonically_increasing_id()), F.lit(shards)))

    def gather(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        # a null id becomes the least integer and is turned back
        items = np.stack([rows.column(c).cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy() for c in _FIELDS]).tobytes()
        return pa.table({"shard": pa.array([key[0].as_py()] * islands, pa.int64()), "island": pa.array(range(islands), pa.int32()), "items": pa.array([items] * islands, pa.binary()), "elite": pa.array([b""] * islands, pa.binary()), "guest": pa.array([b""] * islands, pa.binary())})

    schema = "shard long, island int, items binary, elite binary, guest binary"
    state = save(dealt.groupBy("shard").applyInArrow(gather, schema), "islands")
    for epoch in range(epochs):

        def generation(batches: Iterator[pa.RecordBatch], epoch: int = epoch) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                elites = []
                for row in batch.to_pylist():
                    length = np.frombuffer(row["items"], np.int64).reshape(len(_FIELDS), -1)[3]
                    guests = [np.frombuffer(row[c], np.int32).astype(np.int64) for c in ("elite", "guest") if row[c]]
                    rng = np.random.default_rng([seed, abs(row["shard"]), row["island"], epoch])
                    elites.append(evolve(length, guests, capacity, rng).astype(np.int32).tobytes())
                yield batch.set_column(batch.schema.get_field_index("elite"), "elite", pa.array(elites, pa.binary()))

        state = save(state.repartition("shard", "island").mapInArrow(generation, schema), "islands")
        if epoch + 1 < epochs:
            travel = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("elite").alias("guest"))
            state = state.drop("guest").join(travel, ["shard", "island"]).select("shard", "island", "items", "elite", "guest")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = [fitness(np.frombuffer(r["elite"], np.int32), np.frombuffer(r["items"], np.int64).reshape(len(_FIELDS), -1)[3], capacity) for r in batch.select(["items", "elite"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("island"), pa.array(value, pa.float64())], ["shard", "island", "fitness"])

    best = state.mapInArrow(judge, "shard long, island int, fitness double").groupBy("shard").agg(F.max_by("island", F.struct("fitness", F.negative("island"))).alias("island"))
    return state.join(best, ["shard", "island"]).select("shard", "items", "elite")


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"


def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a shard's pieces with their sequence's number and fill and the offset in it."""
    for batch in batches:
        for row in batch.to_pylist():
            items = np.frombuffer(row["items"], np.int64).reshape(len(_FIELDS), -1)
            bins = np.frombuffer(row["elite"], np.int32).astype(np.int64)
            order = np.argsort(bins, kind="stable")
            items, bins = items[:, order], bins[order]
            before = np.cumsum(items[3]) - items[3]
            head = np.concatenate([[True], bins[1:] != bins[:-1]])
            offset = before - before[np.flatnonzero(head)][np.cumsum(head) - 1]
            doc = pa.array(items[0], mask=items[0] == np.iinfo(np.int64).min)
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array(items[1].astype(np.int32)), *map(pa.array, items[2:]), pa.array((row["shard"] << 24) + bins), pa.array(offset), pa.array(fills(bins, items[3])[bins])], ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"]
            )


def pack(
    docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, shard_rows: int = 1500, islands: int = 2, epochs: int = 2, well_filled: float = 0.985, seed: int = 42
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; a sequence holds at most ``capacity`` ids.

    Texts (null: empty) become ids by the vocabulary file ``tokenizer`` and id 0. Only longer ones are cut; a full piece is a sequence of
    its own. The others are dealt to shards of about ``shard_rows`` and packed; what lies in sequences filled below
    ``well_filled`` is dealt to new shards and packed once more. Rows repeated under a doc_id are packed each, a null doc_id stays null;
    extra columns are ignored; an empty table gives an empty one.
    """
    cut = save(pieces(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), capacity), "pieces")
    full = cut.where(F.col("length") == capacity).withColumn("sequence_id", F.monotonically_increasing_id() * 3).withColumn("offset", F.lit(0).cast("long"))
    once = save(pack_rest(cut.where(F.col("length") < capacity), capacity, shard_rows, islands, epochs, seed).mapInArrow(unfold, _PACKED), "packed")
    loose = once.where(F.col("fill") < well_filled * capacity).select(*_FIELDS)
    again = pack_rest(loose, capacity, shard_rows, islands, epochs, seed + 1).mapInArrow(unfold, _PACKED)
    done = once.where(F.col("fill") >= well_filled * capacity).withColumn("sequence_id", F.col("bin") * 3 + 1)
    done = done.unionByName(again.withColumn("sequence_id", F.col("bin") * 3 + 2))
    return full.unionByName(done.drop("bin", "fill"))

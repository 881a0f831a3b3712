"""SentencePiece encoding with seeded merge-dropout, and decoding without loss.

The model's pieces and scores come from its file. A text is split into chunks that no piece crosses: a run of spaces
with the characters up to the next space, line ends by themselves. In a chunk, adjacent symbols whose join is a piece
are merge candidates; an agenda merges the best one first, the leftmost of equals. A candidate is skipped for good if a
hash keyed by the seed, the text's id, the chunk's place in the text, and the candidate's place and two symbols is below
the dropout: every occurrence of a word draws for itself.

Chunks of a batch are worked on side by side in numpy. Of each different one the way without skips is worked out once
and kept, with its candidates; occurrences that skip none of them have its result, all others are merged by themselves.
Spaces become the piece file's space mark, one more goes before the text, and characters without a piece (the mark
itself among them) become byte pieces: so decoding gives back every text byte by byte.
"""

from __future__ import annotations

import heapq
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequill.llm.packing import ranges
from pagequill.llm.staging import ship
from pagequill.llm.words import BYTE_PRIME, Texts, inverse, mix, power_at, prefix, texts

DROPOUT = 0.1
SEED = 17
LONG = 64
KEPT_BYTES = 16 << 20
SLICE = 1 << 20
SIDE_BY_SIDE = 30_000
MARK = "▁"
NEVER = np.int64(1 << 62)


class Pieces:
    """The vocabulary as arrays: characters, merges and the bytes of each piece."""

    ARRAYS = ("byte", "char", "pair", "joined", "rank", "slot", "lengths", "offsets", "written")

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [k for k in range(n) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
        names = {model.id_to_piece(k): k for k in plain}
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.char = np.full(0x110000, -1, np.int32)
        for name, k in names.items():
            if len(name) == 1 and name != MARK:
                self.char[ord(name)] = k
        self.space = names[MARK]
        self.char[ord(" ")] = self.space
        order = {s: r for r, s in enumerate(sorted({model.get_score(k) for k in plain}, reverse=True))}
        merges = [(names[p[:i]] * n + names[p[i:]], k, order[model.get_score(k)]) for p, k in names.items() for i in range(1, len(p)) if p[:i] in names and p[i:] in names]
        merges.sort()
        self.size = n
        self.pair = np.array([m[0] for m in merges], np.int64)
        self.joined = np.array([m[1] for m in merges], np.int32)
        self.rank = np.array([m[2] for m in merges], np.int64)
        self._slots()
        written = [b""] * n
        for name, k in names.items():
            written[k] = name.replace(MARK, " ").encode()
        for b, k in enumerate(self.byte):
            written[k] = bytes([b])
        self.lengths = np.array([len(w) for w in written], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.written = np.frombuffer(b"".join(written), np.uint8)

    def save(self, path: str) -> dict:
        """Write all arrays to one file; returns what ``load`` needs to find them in it."""
        plan: dict = {"size": self.size, "space": self.space, "arrays": {}}
        at = 0
        with open(path, "wb") as out:
            for name in self.ARRAYS:
                array = getattr(self, name)
                plan["arrays"][name] = (array.dtype.str, at, array.nbytes)
                padded = array.tobytes() + bytes(-array.nbytes % 8)
                out.write(padded)
                at += len(padded)
        return plan

    @classmethod
    def load(cls, path: str, plan: dict) -> Pieces:
        """The arrays of a file, mapped and not read: all workers of a machine share one copy."""
        out = cls.__new__(cls)
        data = np.memmap(path, np.uint8, "r")
        out.size, out.space = plan["size"], plan["space"]
        for name, (kind, at, n) in plan["arrays"].items():
            setattr(out, name, data[at : at + n].view(kind))
        out.mask = np.uint64(len(out.slot) - 1)
        return out

    def _slots(self) -> None:
        """A hash table of the pairs with open addressing, so that a lookup is two or three gathers."""
        bits = max(4, int(len(self.pair) * 4).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.slot = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(self.pair))
        at = (mix(self.pair.astype(np.uint64)) & self.mask).astype(np.int64)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            beaten = self.slot[at] != left
            left, at = left[beaten], (at[beaten] + 1) & int(self.mask)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge of each pair of symbols, -1 if there is none."""
        pair = a.astype(np.int64) * self.size + b
        out = np.full(len(pair), -1, np.int32)
        live = np.arange(len(pair))
        at = (mix(pair.view(np.uint64)) & self.mask).astype(np.int64)
        while len(live):
            found = self.slot[at]
            some = found >= 0
            live, at, found = live[some], at[some], found[some]
            hit = self.pair[found] == pair[live]
            out[live[hit]] = found[hit]
            live, at = live[~hit], (at[~hit] + 1) & int(self.mask)
        return out

    def symbols(self, chunk: str) -> list[int]:
        """A chunk's first symbols: its characters, or their bytes."""
        out: list[int] = []
        for c in chunk:
            k = int(self.char[ord(c)])
            out += [k] if k >= 0 else self.byte[list(c.encode())].tolist()
        return out


def _skipped(seed: int, variant: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray, dropout: float) -> np.ndarray:
    if dropout <= 0:
        return np.zeros(len(place), bool)
    return _drawn(seed, variant.astype(np.uint64), _candidate(place, left, right), dropout)


def _candidate(place: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)) ^ (place.astype(np.uint64) << np.uint64(20))


def _drawn(seed: int, variant: np.ndarray, candidate: np.ndarray, dropout: float) -> np.ndarray:
    key = mix(candidate ^ variant ^ mix(np.array([seed], np.uint64)))
    return (key >> np.uint64(11)).astype(np.float64) / 2.0**53 < dropout


def merge_one(pieces: Pieces, symbols: list[int], variant: int, seed: int, dropout: float) -> list[int]:
    """The agenda as a heap, for one chunk. Places are numbers of first symbols."""
    ids = list(symbols)
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    agenda: list[tuple[int, int, int, int, int]] = []

    def offer(at: list[int]) -> None:
        at = [i for i in at if i >= 0 and after[i] < len(ids)]
        if not at:
            return
        left, right = np.array([ids[i] for i in at]), np.array([ids[after[i]] for i in at])
        found = pieces.find(left, right)
        gone = _skipped(seed, np.full(len(at), variant), np.array(at), left, right, dropout)
        for i, k, skip in zip(at, found.tolist(), gone.tolist(), strict=True):
            if k >= 0 and not skip:
                heapq.heappush(agenda, (int(pieces.rank[k]), i, ids[i], ids[after[i]], k))

    offer(list(range(len(ids))))
    while agenda:
        _, i, left, right, k = heapq.heappop(agenda)
        j = after[i]
        if ids[i] != left or j >= len(ids) or ids[j] != right:
            continue
        ids[i], ids[j] = int(pieces.joined[k]), -1
        after[i] = after[j]
        if after[i] < len(ids):
            before[after[i]] = i
        offer([before[i], i])
    return [k for k in ids if k >= 0]


def merge_many(pieces: Pieces, ids: np.ndarray, counts: np.ndarray, variants: np.ndarray, seed: int, dropout: float, offered: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The agenda of many chunks side by side: each round merges the best candidate of every chunk that has one.

    All candidates go to ``offered``, each with its chunk.
    """
    ids = ids.copy()
    chunk = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
    order = np.full(len(ids), NEVER)
    merge = np.full(len(ids), -1, np.int32)
    done_ids, done_chunk = [], []

    def offer(at: np.ndarray) -> None:
        """Candidates of the symbols ``at`` with their right neighbours."""
        found = pieces.find(ids[at], ids[at + 1])
        found[(chunk[at] != chunk[at + 1]) | _skipped(seed, variants[chunk[at]], place[at], ids[at], ids[at + 1], dropout)] = -1
        merge[at] = found
        if offered is not None:
            some = at[found >= 0]
            offered.append((chunk[some], _candidate(place[some], ids[some], ids[some + 1])))
        order[at] = np.where(found >= 0, (pieces.rank[found] << np.int64(20)) | place[at], NEVER)

    if len(ids) > 1:
        offer(np.arange(len(ids) - 1))
    while len(ids):
        new = np.ones(len(ids), bool)
        new[1:] = chunk[1:] != chunk[:-1]
        starts = np.flatnonzero(new)
        best = np.minimum.reduceat(order, starts)
        live = best < NEVER
        if not live.all():
            sizes = np.diff(np.append(starts, len(ids)))
            keep = np.repeat(live, sizes)
            done_ids.append(ids[~keep])
            done_chunk.append(chunk[~keep])
            ids, chunk, place, order, merge = ids[keep], chunk[keep], place[keep], order[keep], merge[keep]
            if not len(ids):
                break
            starts = np.concatenate(([0], np.cumsum(sizes[live])))[:-1]
            best = best[live]
        sizes = np.diff(np.append(starts, len(ids)))
        at = np.flatnonzero(order == np.repeat(best, sizes))  # places make it one for each chunk
        ids[at] = pieces.joined[merge[at]]
        gone = np.zeros(len(ids), bool)
        gone[at + 1] = True
        kept = ~gone
        moved = np.cumsum(kept) - 1
        at = moved[at]
        ids, chunk, place, order, merge = ids[kept], chunk[kept], place[kept], order[kept], merge[kept]
        order[at], merge[at] = NEVER, -1
        again = np.concatenate([at, at[at > 0] - 1])
        again = again[again + 1 < len(ids)]
        if len(again):
            offer(again)
    if not done_ids:
        return np.empty(0, np.int32), np.zeros(len(counts), np.int64)
    ids, chunk = np.concatenate(done_ids), np.concatenate(done_chunk)
    return ids[np.argsort(chunk, kind="stable")], np.bincount(chunk, minlength=len(counts))


class Encoder:
    def __init__(self, model: Pieces | str, seed: int = SEED, dropout: float = DROPOUT):
        self.pieces = model if isinstance(model, Pieces) else Pieces(model)
        self.seed, self.dropout = seed, dropout
        self._forget()

    def _forget(self) -> None:
        """Of each chunk: its key, its place in three flat arrays, and how much of each is its own."""
        self.keys = np.empty(0, np.uint64)
        self.at = np.empty((0, 3), np.int64)
        self.sizes = np.empty((0, 3), np.int64)
        self.flat = [np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.uint64)]  # pieces, first symbols, candidates

    def encode(self, part: Texts, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, one after the other, and the number of each text. ``names`` seeds the draws."""
        starts, ends, first = self._chunks(part)
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(len(names), np.int64)
        rows = np.repeat(np.arange(len(names)), np.diff(first))
        head = np.zeros(len(starts), np.uint64)
        head[first[:-1][np.diff(first) > 0]] = 1
        number = (np.arange(len(starts)) - first[rows]).astype(np.uint64)
        variant = mix(mix(names.view(np.uint64)[rows] ^ np.uint64(self.seed)) ^ number)
        sums = prefix(part.data, BYTE_PRIME, 1)
        spelled = (sums[ends] - sums[starts]) * power_at(inverse(BYTE_PRIME), starts)
        keys, one, back = np.unique(mix(mix(spelled) ^ (head << np.uint64(62))), return_index=True, return_inverse=True)
        self._learn(keys, part.data, starts[one], ends[one], head[one])
        found = np.searchsorted(self.keys, keys)[back]
        sizes = self.sizes[found, 0]
        own = np.zeros(len(found), bool)
        for lo in range(0, len(found) if self.dropout > 0 else 0, SIDE_BY_SIDE):
            own[lo : lo + SIDE_BY_SIDE] = self._differs(found[lo : lo + SIDE_BY_SIDE], variant[lo : lo + SIDE_BY_SIDE])
        anew = np.flatnonzero(own)
        merged = []
        for lo in range(0, len(anew), SIDE_BY_SIDE):
            some = anew[lo : lo + SIDE_BY_SIDE]
            counts = self.sizes[found[some], 1]
            sizes[some], ids = self._merged(self.flat[1][ranges(self.at[found[some], 1], counts)], counts, variant[some])
            merged.append(ids)
        out = np.empty(int(sizes.sum()), np.int32)
        place = np.cumsum(sizes) - sizes
        out[ranges(place[~own], sizes[~own])] = self.flat[0][ranges(self.at[found[~own], 0], sizes[~own])]
        if merged:
            out[ranges(place[anew], sizes[anew])] = np.concatenate(merged)
        return out, np.bincount(rows, sizes, len(names)).astype(np.int64)

    def _differs(self, found: np.ndarray, variant: np.ndarray) -> np.ndarray:
        """Which occurrences skip a candidate of the way without skips. Of long chunks that way is not kept."""
        counts = self.sizes[found, 2]
        drawn = _drawn(self.seed, np.repeat(variant, counts), self.flat[2][ranges(self.at[found, 2], counts)], self.dropout)
        of = np.repeat(np.arange(len(found)), counts)
        return (np.bincount(of[drawn], minlength=len(found)) > 0) | (self.sizes[found, 1] > LONG)

    def _chunks(self, part: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        space, line = part.data == 32, part.data == 10
        start = np.zeros(len(part.data), bool)
        start[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        start[part.bounds[:-1][np.diff(part.bounds) > 0]] = True
        starts = np.flatnonzero(start)
        return starts, np.append(starts[1:], len(part.data)), np.searchsorted(starts, part.bounds)

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, head: np.ndarray) -> None:
        if sum(a.nbytes for a in (self.keys, self.at, self.sizes, *self.flat)) > KEPT_BYTES:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        new = np.flatnonzero(new)
        if not len(new):
            return
        lengths = ends[new] - starts[new]
        spread = ranges(starts[new], lengths)
        raw = data[spread]
        points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
        bad = (points >= 0xD800) & (points < 0xE000)
        leads = np.flatnonzero(~((raw & 0xC0) == 0x80)) if not bad.any() else None
        if leads is None:  # bytes that are not UTF-8: chunk by chunk
            symbols = [self._spelled(bytes(data[starts[k] : ends[k]])) for k in new]
            flat = np.array([x for s in symbols for x in s], np.int32)
            counts = np.array([len(s) for s in symbols])
        else:
            of = np.repeat(np.arange(len(new)), lengths)[leads]
            flat = self.pieces.char[points]
            odd = np.flatnonzero(flat < 0)
            widths = np.ones(len(points), np.int64)
            widths[odd] = np.diff(np.append(leads, len(raw)))[odd]
            if len(odd):
                flat = np.repeat(flat, widths)
                bytes_at = ranges(leads[odd], widths[odd])
                flat[flat < 0] = self.pieces.byte[raw[bytes_at]]
            counts = np.bincount(np.repeat(of, widths), minlength=len(new))
        if head[new].any():  # the space before a text
            before = np.cumsum(counts) - counts
            flat = np.insert(flat, before[head[new] > 0], self.pieces.space)
            counts = counts + (head[new] > 0)
        flat = flat.astype(np.int32)
        offered: list[tuple[np.ndarray, np.ndarray]] = []
        if self.dropout > 0:
            short = np.flatnonzero(counts <= LONG)
            sizes = np.zeros(len(counts), np.int64)
            candidates = np.zeros(len(counts), np.int64)
            symbols = flat[ranges((np.cumsum(counts) - counts)[short], counts[short])]
            ids, sizes[short] = merge_many(self.pieces, symbols, counts[short], np.zeros(len(short), np.uint64), self.seed, 0.0, offered)
            of, offers = (np.concatenate([x[k] for x in offered]) if offered else np.empty(0, np.int64) for k in (0, 1))
            offers = offers.astype(np.uint64)[np.argsort(of, kind="stable")]
            candidates[short] = np.bincount(of, minlength=len(short))
        else:
            sizes, ids = self._merged(flat, counts, np.zeros(len(counts), np.uint64))
            offers, candidates = np.empty(0, np.uint64), np.zeros(len(counts), np.int64)
        all_sizes = np.stack([sizes, counts, candidates], 1)
        base = np.array([len(f) for f in self.flat])
        all_keys = np.concatenate([self.keys, keys[new]])
        order = np.argsort(all_keys, kind="stable")
        self.keys = all_keys[order]
        self.at = np.concatenate([self.at, base + np.cumsum(all_sizes, axis=0) - all_sizes])[order]
        self.sizes = np.concatenate([self.sizes, all_sizes])[order]
        self.flat = [np.concatenate([f, more]) for f, more in zip(self.flat, (ids, flat, offers), strict=True)]

    def _spelled(self, raw: bytes) -> list[int]:
        out: list[int] = []
        for c in raw.decode("utf-8", "surrogateescape"):
            out += [int(self.pieces.byte[ord(c) - 0xDC00])] if 0xDC80 <= ord(c) <= 0xDCFF else self.pieces.symbols(c)
        return out

    def _merged(self, flat: np.ndarray, counts: np.ndarray, variant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        long = counts > LONG
        if not long.any():
            ids, sizes = merge_many(self.pieces, flat, counts, variant, self.seed, self.dropout)
            return sizes, ids
        starts = np.cumsum(counts) - counts
        short = np.flatnonzero(~long)
        ids, sizes = merge_many(self.pieces, flat[ranges(starts[short], counts[short])], counts[short], variant[short], self.seed, self.dropout)
        parts = np.split(ids, np.cumsum(sizes)[:-1]) if len(short) else []
        out: list[np.ndarray] = [None] * len(counts)  # type: ignore[list-item]
        for k, ids_of in zip(short.tolist(), parts, strict=True):
            out[k] = ids_of
        for k in np.flatnonzero(long).tolist():
            out[k] = np.array(merge_one(self.pieces, flat[starts[k] : starts[k] + counts[k]].tolist(), int(variant[k]), self.seed, self.dropout), np.int32)
        return np.array([len(x) for x in out]), np.concatenate(out)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts without the space before each, and the number of each text."""
        lengths = self.pieces.lengths[ids]
        data = self.pieces.written[ranges(self.pieces.offsets[ids], lengths)]
        rows = np.repeat(np.arange(len(counts)), counts)
        sizes = np.bincount(rows, lengths, len(counts)).astype(np.int64)
        keep = np.ones(len(data), bool)
        keep[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
        return data[keep], sizes - (sizes > 0)


def ship_pieces(spark: SparkSession, model_path: str) -> tuple[str, dict]:
    """Read a model once, in the driver, and send its arrays to every executor as one file; once for each Spark context."""
    context = spark.sparkContext
    sent = context.__dict__.setdefault("_llm_pieces", {})
    if model_path not in sent:
        folder = tempfile.mkdtemp(prefix="llm-")
        name = f"pieces-{uuid.uuid4().hex}.bin"
        plan = Pieces(model_path).save(f"{folder}/{name}")
        context.addFile(f"{folder}/{name}")
        sent[model_path] = (name, plan)
    return sent[model_path]


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, dropout: float = DROPOUT) -> DataFrame:
    """``(id, n_pieces, piece_ids, n_bytes, lossless)`` for each row of ``docs``.

    ``lossless`` says that decoding ``piece_ids`` gave the text's own bytes. Null and empty texts have no pieces. A null
    id draws as the smallest long does. Other columns are ignored.
    """
    ship(docs.sparkSession)
    name, plan = ship_pieces(docs.sparkSession, model_path)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Pieces.load(SparkFiles.get(name), plan), seed, dropout)
        for batch in batches:
            for part in texts(batch.column("text"), SLICE):
                own = batch.column("id").slice(part.lo, part.hi - part.lo)
                ids, counts = encoder.encode(part, own.fill_null(np.iinfo(np.int64).min).to_numpy())
                data, sizes = encoder.decode(ids, counts)
                right = np.array_equal(sizes, np.diff(part.bounds)) and np.array_equal(data, part.data)
                same = np.full(len(own), right) if right else _same(data, sizes, part)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([own, pa.array(counts), lists, pa.array(sizes), pa.array(same)], ["id", "n_pieces", "piece_ids", "n_bytes", "lossless"])

    return rows.mapInArrow(run, "id long, n_pieces long, piece_ids array<int>, n_bytes long, lossless boolean")


def _same(data: np.ndarray, sizes: np.ndarray, part: Texts) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.array([np.array_equal(data[e - n : e], part.data[a:b]) for e, n, a, b in zip(ends, sizes, part.bounds[:-1], part.bounds[1:], strict=True)])

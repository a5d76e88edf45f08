"""Distinct sampled segmentations of texts into SentencePiece pieces, by Gumbel top-k without replacement.

The pieces of a model span a lattice over a text; a path through it is a segmentation. A piece weighs
1 / (id + 1): ids follow frequency. A character that no piece spells is spelled by its bytes. A path's probability
is its share of the weight of all paths, and falls apart into steps: the chance of the next piece, given the
place. Perturbed with Gumbel noise, the k best paths are k draws without replacement. They are found best first:
a path's noise is the maximum below its first step, and at every step the paths turning off there are one
entry, whose maximum is a Gumbel draw truncated at the path's own. The best entry is drawn next, and splits up
likewise. The entry that follows the k-th path bounds the noise of all paths not drawn, which gives a path's
inclusion score: log(1 - exp(-exp(log p - bound))).

Noise is a hash of seed, row key, draw and place, so results do not depend on partitions. Lattices are built
once for each distinct unit, a stretch from one run of spaces to the next line or space, across which no piece
reaches; a unit's lattice of any length fits, as do texts.

Null and empty texts have one segmentation, the empty one, of score 0. A text with fewer than k segmentations gives
those it has. Rows with the same key and text draw the same. The space mark in a text decodes as a space, so that such a
text is not the one that its ids decode to.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import columns, mix64, renamed, slices, texts, unit

SPACE = "▁"
#: Draws for each text.
DRAWS = 2
_UNIT = re.compile(" +[^ \n]*|[^ \n]+|\n")
#: An entry this much (in natural logs) below the best one cannot pass it in double precision.
NEGLIGIBLE = 40.0
_A, _B, _C = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


class Pieces:
    """The pieces of a model: their ids by spelling, log weights and bytes."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        self.log_weight = -np.log(np.arange(n) + 1.0)
        self.byte_id = np.zeros(256, np.int64)
        self.spelled = [b""] * n
        words, ids = [], []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.spelled[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if "\n" in piece and piece != "\n" or SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {piece!r} reaches across units")
                words.append(piece.replace(SPACE, " "))
                ids.append(i)
                self.spelled[i] = words[-1].encode()
        self.longest = max(map(len, words))
        self.tables = [self._table([(w, i) for w, i in zip(words, ids, strict=True) if len(w) == size]) for size in range(1, self.longest + 1)]

    @staticmethod
    def roll(h: np.ndarray, chars: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (h + chars) * _A ^ (h >> np.uint64(29))

    def _table(self, pieces: list[tuple[str, int]]):
        """Open hash table of the pieces of one length: keys and ids, probed one slot after another."""
        bits = max(4, int(np.ceil(np.log2(4 * len(pieces) + 1))))
        keys, ids = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        for word, i in pieces:
            h = np.zeros(1, np.uint64)
            for c in word:
                h = self.roll(h, np.array([ord(c)], np.uint64))
            at = int(h[0] >> np.uint64(64 - bits))
            while ids[at] >= 0:
                at = (at + 1) % len(ids)
            keys[at], ids[at] = h[0], i
        return bits, keys, ids

    def find(self, size: int, h: np.ndarray) -> np.ndarray:
        bits, keys, ids = self.tables[size - 1]
        slot = (h >> np.uint64(64 - bits)).astype(np.int64)
        found = ids[slot]
        todo = np.flatnonzero((found >= 0) & (keys[slot] != h))
        while len(todo):
            slot[todo] = (slot[todo] + 1) % len(ids)
            found[todo] = ids[slot[todo]]
            todo = todo[(found[todo] >= 0) & (keys[slot[todo]] != h[todo])]
        return found

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation."""
        text = b"".join(map(self.spelled.__getitem__, ids)).decode(errors="replace")
        return text[1:] if text[:1] == " " else text


class Lattices:
    """Lattices of distinct units. Nodes are numbered by how many characters are left to their unit's end, then by unit,
    longer units first: so all nodes at one distance lie side by side, the ends come first, and every step of the
    recursion is on whole stretches. Edge ``node * width + n - 1`` is the piece of n characters at a node: its chance
    there, 0 if there is none, in single precision, and its piece; pieces below 0 are characters as bytes."""

    def __init__(self, pieces: Pieces, units: list[str]) -> None:
        self.width, self.ends = 1, len(units)
        #: The first node of each unit's lattice.
        self.start = np.zeros(0, np.int64)
        self.level, self.left = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.chance, self.piece = np.zeros(0, np.float32), np.zeros(0, np.int32)
        self.sums = np.zeros((0, 1), np.float32)
        if units:
            self._build(pieces, units)

    def target(self, edges: np.ndarray) -> np.ndarray:
        node = edges // self.width
        left = self.left[node]
        return node - self.level[left] + self.level[left - (edges - node * self.width) - 1]

    def _build(self, p: Pieces, units: list[str]) -> None:
        size = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(-size, kind="stable")
        size, units = size[order], [units[i] for i in order.tolist()]
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        stops, longest = np.cumsum(size), int(size[0])
        count = np.searchsorted(-size, -np.arange(longest + 1), side="right")
        self.level = level = np.concatenate(([0], np.cumsum(count)))
        self.left = np.repeat(np.arange(longest + 1, dtype=np.int32), count)
        self.start = np.empty(len(units), np.int64)
        self.start[order] = level[size] + np.arange(len(units))
        at = [chars[stops[:m] - max(left, 1)] for left, m in enumerate(count)]
        found: list[list[np.ndarray]] = [[]]
        width = 1
        for left in range(1, longest + 1):
            m, h, own = count[left], np.zeros(count[left], np.uint64), []
            for n in range(1, min(left, p.longest) + 1):
                h = p.roll(h, at[left - n + 1][:m])
                got = p.find(n, h)
                if n > width and (got >= 0).any():
                    width = n
                own.append(got)
            found.append(own)
        self.width = width
        weights = np.append(p.log_weight, -np.inf)  # a piece not found is -1, the last one
        chance, sums = np.zeros((level[-1], width), np.float32), np.zeros((level[-1], width), np.float32)
        piece = np.zeros((level[-1], width), np.int32)
        rest = [np.zeros(count[0])]
        for left in range(1, longest + 1):
            m, here, own = count[left], slice(level[left], level[left] + count[left]), found[left][:width]
            paths = np.empty((len(own), m))
            for n, got in enumerate(own, 1):
                paths[n - 1] = weights[got]
                piece[here, n - 1] = got
                if n == 1 and (got < 0).any():
                    bare = np.flatnonzero(got < 0)
                    codes = at[left][bare]
                    for code in np.unique(codes).tolist():
                        spelled = p.byte_id[list(chr(code).encode("utf-8", "surrogatepass"))]
                        place = bare[codes == code]
                        piece[here.start + place, 0] = spelled[0] if len(spelled) == 1 else -1 - code
                        paths[0, place] = p.log_weight[spelled].sum()
                paths[n - 1] += rest[left - n][:m]
            top = paths.max(axis=0)
            paths -= top
            np.exp(paths, out=paths)
            total = paths.sum(axis=0)
            rest.append(top + np.log(total))
            paths /= total
            chance[here, : len(own)] = paths.T
            np.cumsum(paths, axis=0, out=paths)
            sums[here, : len(own)] = paths.T
            sums[here, len(own) :] = sums[here, len(own) - 1 : len(own)]
            found[left] = []
        self.chance, self.piece, self.sums = chance.ravel(), piece.ravel(), sums

    def walk(self, node: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draws a path from each node to its unit's end: edges in order, and how many each has."""
        steps, owner, n = [], [], np.zeros(len(node), np.int64)
        on = np.flatnonzero(node >= self.ends)
        at = node[on]
        while len(on):
            sums = self.sums[at]
            u = (unit(mix64(seed[on] + n[on].astype(np.uint64) * _C)) * sums[:, -1]).astype(np.float32)
            u = np.minimum(u, np.nextafter(sums[:, -1], np.float32(0)))
            edge = at * self.width + (sums <= u[:, None]).sum(axis=1, dtype=np.int8)
            steps.append(edge)
            owner.append(on)
            n[on] += 1
            at = self.target(edge)
            go = at >= self.ends
            on, at = on[go], at[go]
        place = np.cumsum(n) - n
        flat = np.empty(int(n.sum()), np.int64)
        for k, (edge, on) in enumerate(zip(steps, owner, strict=True)):
            flat[place[on] + k] = edge
        return flat, n


def units_of(text: str) -> list[str]:
    """Stretches of the text, with a space put before it, that pieces do not reach across."""
    return _UNIT.findall(" " + text.replace(SPACE, " ")) if text else []


def _log1mexp(x: float) -> float:
    """log(1 - exp(-x)) for x > 0."""
    return float(np.log(-np.expm1(-x)) if x < 0.69 else np.log1p(-np.exp(-x)))


class _Row:
    """The draws of one text so far, and what could be drawn next."""

    def __init__(self, seed: np.uint64, nodes: np.ndarray) -> None:
        self.seed, self.nodes, self.entries, self.found, self.n = seed, nodes, [], [], 0

    def turn_offs(self, edges: np.ndarray, chance: np.ndarray, logs: np.ndarray, before: float, top: float, skip: int, draw: int, most: int) -> None:
        """Entries for the paths that leave this one at its steps from ``skip`` on; no more than the ``most`` best
        of them can ever be taken."""
        at, log_p, best, found = skip, before, -np.inf, []
        while at < len(edges) and (best == -np.inf or log_p > best - NEGLIGIBLE):
            n = max(512, at - skip)
            c, own = chance[at : at + n], logs[at : at + n]
            prefix = log_p + np.cumsum(own) - own
            turn = np.flatnonzero(c < 1)
            place = prefix[turn] + np.log1p(-c[turn])
            u = unit(mix64(self.seed ^ ((at + turn).astype(np.uint64) * _B + np.uint64(draw * 0x9E3779B9))))
            g = _truncated(place, top, u)
            found += [(float(g[i]), at + int(turn[i]), float(prefix[turn[i]])) for i in np.argsort(-g)[:most]]
            best = max([best, *[f[0] for f in found]])
            log_p = float(prefix[-1] + own[-1])
            at += n
        for g, i, log_p in sorted(found, reverse=True)[:most]:
            self.n += 1
            heapq.heappush(self.entries, (-g, self.n, edges[:i], log_p, {int(edges[i])}))


@np.errstate(over="ignore")
def sample(texts_: list[str], keys: list[bytes], pieces: Pieces, draws: int = DRAWS, seed: int = 0):
    """Per text its draws, best first: (piece codes, log probability, log inclusion)."""
    number: dict[str, int] = defaultdict(count().__next__)
    cut = [list(map(number.__getitem__, units_of(t))) for t in texts_]
    lattices = Lattices(pieces, list(number))
    seeds = [np.uint64(xxhash.xxh3_64_intdigest(k, seed=seed)) for k in keys]
    rows = [_Row(s, lattices.start[np.array(c, np.int64)]) for s, c in zip(seeds, cut, strict=True)]
    # Each job: row, steps so far, their log probability, the node inside a unit to go on from or -1, the unit
    # after that, and the noise of the best path below.
    jobs = [(r, np.zeros(0, np.int64), 0.0, -1, 0, _gumbel(r.seed)) for r in rows if len(r.nodes)]
    for draw in range(draws):
        if not jobs:
            break
        starts, marks = [], []
        for r, _, _, inside, following, _ in jobs:
            own = r.nodes[following:] if inside < 0 else np.concatenate(([inside], r.nodes[following:]))
            at = np.arange(len(r.nodes) - len(own), len(r.nodes)).astype(np.uint64)
            starts.append(own)
            marks.append(mix64(r.seed + at * _A + np.uint64(draw + 1) * _B))
        flat, n = lattices.walk(np.concatenate(starts), np.concatenate(marks))
        sizes = np.cumsum([len(x) for x in starts])[:-1]
        steps = np.cumsum([int(x.sum()) for x in np.split(n, sizes)])[:-1]
        for (r, before, log_p, _, _, top), edges in zip(jobs, np.split(flat, steps), strict=True):
            path = np.concatenate([before, edges])
            chance = lattices.chance[path].astype(np.float64)
            logs = np.log(chance)
            r.found.append((lattices.piece[path], float(logs.sum())))
            r.turn_offs(path, chance, logs, log_p, top, len(before), draw, draws - draw)
        if draw + 1 < draws:
            jobs = [job for r in rows if (job := _next(r, lattices, draw)) is not None]
    return [_scored(r) for r in rows]


def _gumbel(seed: np.uint64) -> float:
    return float(-np.log(-np.log(unit(mix64(np.array([seed], np.uint64)))[0])))


def _truncated(place: np.ndarray, top: float, u: np.ndarray) -> np.ndarray:
    """Gumbel draws at ``place`` given that they are at most ``top``."""
    return place - np.log(np.exp(np.minimum(place - top, 700.0)) - np.log(u))


def _scored(r: _Row) -> list[tuple[np.ndarray, float, float]]:
    if not len(r.nodes):
        return [(np.zeros(0, np.int64), 0.0, 0.0)]
    bound = -r.entries[0][0] if r.entries else -np.inf
    return [(p, lp, log_inclusion(lp - bound)) for p, lp in r.found]


def log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x)))."""
    if x > 5:
        return 0.0
    return float(np.log(-np.expm1(-np.exp(x)))) if x > -30 else x


def _next(r: _Row, lattices: Lattices, draw: int):
    """Takes the best entry, draws which of its turns holds its maximum, and leaves the others as an entry."""
    if not r.entries:
        return None
    g, _, before, log_p, used = heapq.heappop(r.entries)
    top = -g
    node = next(iter(used)) // lattices.width
    edges = np.arange(node * lattices.width, (node + 1) * lattices.width)
    edges = edges[(lattices.chance[edges] > 0) & ~np.isin(edges, list(used))]
    chance = lattices.chance[edges].astype(np.float64)
    noise = unit(mix64(r.seed + np.uint64(draw + 1) * _C + np.arange(2, dtype=np.uint64)))
    pick = min(int(np.searchsorted(np.cumsum(chance), noise[0] * chance.sum())), len(edges) - 1)
    left = float(np.delete(chance, pick).sum())
    if left > 0:
        again = float(_truncated(np.array([log_p + np.log(left)]), top, noise[1:])[0])
        r.n += 1
        heapq.heappush(r.entries, (-again, r.n, before, log_p, {*used, int(edges[pick])}))
    path = np.concatenate([before, edges[pick : pick + 1]])
    to = lattices.target(path)
    ended = to < lattices.ends
    following = int(ended.sum()) + (not ended[-1])
    inside = -1 if ended[-1] else int(to[-1])
    return r, path, log_p + float(np.log(chance[pick])), inside, following, top


def ids_of(codes: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Piece ids, characters without a piece spelled out as bytes."""
    if not (codes < 0).any():
        return codes
    out: list[int] = []
    for c in codes.tolist():
        out += [c] if c >= 0 else pieces.byte_id[list(chr(-1 - c).encode("utf-8", "surrogatepass"))].tolist()
    return np.array(out, np.int64)


_PIECES: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def segment(documents: DataFrame, model_path: str, carry: list[str], key_col: str = "doc_id", text_col: str = "text", draws: int = DRAWS, seed: int = 0, slice_bytes: int = 4_000_000) -> DataFrame:
    """For every document one row for each draw: ``carry``, whatever their names, then sg_rank (from 0), sg_ids, sg_log_p,
    sg_log_inclusion and sg_round_trip (the ids decode to the text)."""
    plain_rows, kept_names = renamed(documents, carry)
    key_name, text_name = (plain_rows.columns[documents.columns.index(c)] for c in (key_col, text_col))
    rows = plain_rows.select(*kept_names, F.col(key_name).cast("string").alias("sg_key"), F.col(text_name).cast("string").alias("sg_text"))
    added = [
        T.StructField("sg_rank", T.IntegerType()), T.StructField("sg_ids", T.ArrayType(T.IntegerType())), T.StructField("sg_log_p", T.DoubleType()),
        T.StructField("sg_log_inclusion", T.DoubleType()), T.StructField("sg_round_trip", T.BooleanType()),
    ]
    schema = T.StructType([*[rows.schema[c] for c in kept_names], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model_path)
        for batch in slices(batches, 1 << 20, "sg_text", slice_bytes):
            own = [(t or b"").decode(errors="replace") for t in texts(batch, "sg_text")]
            keys = [str(k).encode() for k in columns(batch, ["sg_key"])[0].to_pylist()]
            at, rank, ids, log_p, inclusion, good = [], [], [], [], [], []
            for i, (text, found) in enumerate(zip(own, sample(own, keys, pieces, draws, seed), strict=True)):
                plain = (" " + text).encode("utf-8", "surrogatepass") if text else b""
                for k, (codes, lp, inc) in enumerate(found):
                    got = ids_of(codes, pieces)
                    at.append(i)
                    rank.append(k)
                    ids.append(got.astype(np.int32))
                    log_p.append(lp)
                    inclusion.append(inc)
                    good.append(b"".join(map(pieces.spelled.__getitem__, got.tolist())) == plain)
            kept = batch.select(kept_names).take(pa.array(at, pa.int64()))
            values = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays(
                [*columns(kept, kept_names), pa.array(rank, pa.int32()), lists, pa.array(log_p, pa.float64()), pa.array(inclusion, pa.float64()), pa.array(good, pa.bool_())],
                names=schema.names,
            )

    return rows.mapInArrow(run, schema).toDF(*carry, *[f.name for f in added])


def decode(segmented: DataFrame, model_path: str, carry: list[str], ids_col: str = "sg_ids") -> DataFrame:
    """Columns ``carry`` of every row, whatever their names, then sg_text, the text of its ids; null ids give null, ids
    beyond the model and those of control pieces give nothing."""
    plain, kept = renamed(segmented, carry)
    rows = plain.select(*kept, F.col(plain.columns[segmented.columns.index(ids_col)]).cast("array<int>").alias("ids"))
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("sg_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model_path)
        known = range(len(pieces.spelled))
        for batch in slices(batches, 1024):
            ids = columns(batch, ["ids"])[0].to_pylist()
            got = [None if x is None else pieces.decode([i for i in x if i in known]) for x in ids]
            yield pa.RecordBatch.from_arrays([*columns(batch, kept), pa.array(got, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema).toDF(*carry, "sg_text")


def op8_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every draw."""
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = segment(documents, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])
    return found.select(
        "doc_id", F.col("sg_rank").alias("draw"), F.size("sg_ids").cast("long").alias("n_pieces"), F.xxhash64("sg_ids").alias("ids_hash"),
        F.col("sg_log_p").alias("log_probability"), F.col("sg_log_inclusion").alias("log_inclusion"), F.col("sg_round_trip").alias("round_trip"),
    )

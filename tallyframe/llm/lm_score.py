"""Language-model scoring with a hierarchical Pitman-Yor model.

Every word seen in training, and the start of a text, is a context with a restaurant of its own; all
share one parent restaurant over single words, whose own base is uniform over the known words and one
unknown. Each table in a context restaurant is a customer of the parent. A text's end and the start
of the next are one symbol: as a word it is the end, as a context the start.

Beside a sample for the frequent words, texts are split into words once, in runs of about BATCH
tokens. A run sends its distinct (context, word) pairs,
with their counts in training, to groups by word; a word with more than GROUP tokens is split over
groups by its contexts, and the parent's part of it is drawn from the sum over them. A group keeps the
pairs that occur in training, and for each run the places of the run's pairs and words among its own:
so the runs' questions need not be sent again, and what a group knows goes back to the runs as small
numbers in the order in which they sent their pairs. A text's sum is made where its tokens are.

A pair seen once has one table. In a sweep a group reseats the customers of each other pair in one
block: they come one by one, each run of customers until the next new table being one beta-geometric
draw, which is the same chain at any count; the seating is taken with the ratio of its normalisers to
those of the seating it replaces (Metropolis-Hastings within Gibbs). The tables of a word in the
context restaurants are then reseated in the parent. Groups need of each other only their contexts'
totals of tables: a context belongs to the group of its word, which sums what the others send it
before each pass, and answers. Concentrations are drawn between passes from their posterior on a grid,
given the seatings; discounts are n1 / (n1 + 2 n2). Predictive probabilities are averaged over SAMPLES
seatings.

Defined cases: a null text is empty and has only the end token; a null doc_id is kept and its fold
is that of the empty text; repeated rows are documents of their own; an empty table gives no rows;
without training rows every token is unknown; other columns are ignored.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TEXTS, crc_mod, drop_stored, stored
from .shingles import scrambled

SAMPLES, BURN = 3, 2
#: Tokens of a group of pairs, and of a run of texts.
GROUP, BATCH = 400_000, 1_000_000
#: A text in so many, by its hash, tells how many groups there are and which words are split over them: no result depends on it.
SHARE = 16
#: Words that may be split over groups (a share of more than 1/WIDE of all tokens).
WIDE = 1 << 16
GRID = np.geomspace(0.01, 1000.0, 61)
END = np.uint64(0x0E0D)
#: Contexts are told apart by the high 48 bits of their words' hashes.
NARROW, CONTEXT_BYTES = np.uint64(16), 6
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _narrow(x: np.ndarray) -> np.ndarray:
    """The low bytes of each 48-bit number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CONTEXT_BYTES])


def _wide(data) -> np.ndarray:
    narrow = np.frombuffer(data, np.uint8).reshape(-1, CONTEXT_BYTES)
    out = np.zeros((len(narrow), 8), np.uint8)
    out[:, :CONTEXT_BYTES] = narrow
    return out.view("<u8").reshape(-1)


def _planes(x: np.ndarray) -> bytes:
    """Numbers from 0 byte by byte, the lowest bytes first, as many as the largest has."""
    import zstandard

    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    data = np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(data.tobytes())


def _from_planes(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<i8").reshape(-1)


def _steps(x: np.ndarray) -> bytes:
    """Growing 48-bit numbers."""
    return _planes(np.diff(x.astype(np.int64), prepend=0))


def _from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data)).astype(np.uint64)


def _cut(x: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of numbers, cut at the bounds."""
    size = x.itemsize * (x.shape[1] if x.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * size).astype("<i4")), pa.py_buffer(np.ascontiguousarray(x))])


def _cut_small(x: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """Numbers from 0 cut at the bounds, a byte each; those from 255 on follow in a second column."""
    large = x >= 255
    return [_cut(np.minimum(x, 255).astype(np.uint8), bounds), _cut(x[large].astype("<i8"), np.append(0, np.cumsum(large))[bounds])]


def _small(low, large) -> np.ndarray:
    """The numbers of all rows of the two columns."""
    out = np.frombuffer(b"".join(low), np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(b"".join(large), "<i8")
    return out


def _bounds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted numbers: the distinct ones, and where each begins and the last ends."""
    first = np.append(True, x[1:] != x[:-1]).nonzero()[0] if len(x) else np.zeros(0, np.int64)
    return x[first], np.append(first, len(x))


class _Local(dict):
    """Word -> its place among a run's words, and the words' hashes; the end has place 0."""

    def __init__(self):
        self.hashes = [int(END)]

    def __missing__(self, word):
        import xxhash

        k = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return k


def _runs(batches, columns=()):
    """Runs of texts of about BATCH tokens: each token's place among the run's words (a text's end
    included), the words' hashes, the texts' lengths, and the rows' other columns."""
    end, local, parts, lengths, kept, n = np.zeros(1, np.int64), _Local(), [], [], [], 0
    for t in batches:
        other, at = pa.RecordBatch.from_arrays([t.column(c) for c in columns], names=list(columns)) if columns else None, 0
        for i, text in enumerate(t.column("text")):
            words = (text.as_py() or "").encode().lower().split()
            parts += [np.fromiter(map(local.__getitem__, words), np.int64, len(words)), end]
            lengths.append(len(words) + 1)
            n += len(words) + 1
            if n >= BATCH:
                if columns:
                    kept.append(other.slice(at, i + 1 - at))
                yield np.concatenate(parts), np.array(local.hashes, np.uint64), np.array(lengths), kept
                local, parts, lengths, kept, n, at = _Local(), [], [], [], 0, i + 1
        if columns and at < t.num_rows:
            kept.append(other.slice(at))
    if lengths:
        yield np.concatenate(parts), np.array(local.hashes, np.uint64), np.array(lengths), kept


def _before(x: np.ndarray, lengths: np.ndarray, start) -> np.ndarray:
    """What stands before each token in its text."""
    u = np.empty_like(x)
    u[1:] = x[:-1]
    u[np.concatenate(([0], np.cumsum(lengths)[:-1]))] = start
    return u


def _pairs(at: np.ndarray, lengths: np.ndarray, n_words: int, end: int) -> np.ndarray:
    """Each token's pair of places, its own and that of the word before it; before a text is its end's place."""
    return at * n_words + _before(at, lengths, end)


class _Groups:
    """Where words and pairs live: by word, and for split words by the context too."""

    def __init__(self, groups: int, split: np.ndarray, pieces: np.ndarray):
        self.groups, self.split, self.pieces = groups, split, pieces

    def split_id(self, w: np.ndarray) -> np.ndarray:
        """The place among the split words, or -1."""
        if not len(self.split):
            return np.full(len(w), -1)
        at = np.searchsorted(self.split, w)
        at[at == len(self.split)] = 0
        return np.where(self.split[at] == w, at, -1)

    def of_context(self, u: np.ndarray) -> np.ndarray:
        return (scrambled(u) % np.uint64(self.groups)).astype(np.int64)

    def of_word(self, w: np.ndarray) -> np.ndarray:
        return self.of_context(w >> NARROW)

    def of_piece(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Of a pair of a split word, given by its place, and a context."""
        piece = scrambled(u) % self.pieces[at] + np.uint64(1)
        return self.of_word(self.split[at] + piece * _MIX)


def _frequent(batches):
    """(w, n) of the words that are frequent in a run of the sampled texts, and (null, tokens)."""
    for at, words, _, _ in _runs(batches):
        n = np.bincount(at, minlength=len(words))
        keep = n * WIDE > len(at)
        ids = [*words[keep].view(np.int64).tolist(), None]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([*n[keep].tolist(), len(at)], pa.int64())], names=["w", "n"])


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _batch(schema: str, *columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=_names(schema))


def _frame(schema: str, columns: dict) -> pd.DataFrame:
    """A frame of the schema's columns, null where none is given."""
    return pd.DataFrame(columns).reindex(columns=_names(schema)).astype(object).where(lambda x: x.notna(), None)


DEALT = "g long, batch long, w binary, reps binary, reps_large binary, u binary, n binary, n_large binary, tokens binary, header binary, gw binary, split binary, pieces binary"


def _deal(sent):
    """Each run's distinct pairs by group, and a row (g < 0) of its texts and tokens."""

    def run(batches):
        from pyspark import TaskContext

        part, where = TaskContext.get().partitionId(), sent.value
        for k, (at, words, lengths, kept) in enumerate(_runs(batches, ("doc_id", "held_out"))):
            batch, order = (part << 24) + k, np.argsort(words)  # words in order of their hashes, so pairs are sent in the order in which groups hold them
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            words, at = words[order], place[at]
            header = pa.Table.from_batches(kept).append_column("n_tokens", pa.array(lengths, pa.int64()))
            learned = np.array([x is False for x in header.column("held_out").to_pylist()])
            pairs, back = np.unique(_pairs(at, lengths, len(words), place[0]), return_inverse=True)
            n = np.bincount(back, np.repeat(learned, lengths), len(pairs)).astype(np.int64)
            w, u = pairs // len(words), pairs % len(words)
            gw, split = where.of_word(words), where.split_id(words)
            g, own = gw[w], split[w] >= 0
            g[own] = where.of_piece(split[w[own]], words[u[own]] >> NARROW)
            pieces, order = g[own], np.argsort(g, kind="stable")
            g, w, u, n = g[order], w[order], u[order], n[order]
            ids, bounds = _bounds(g)
            _, by_word = _bounds(g * len(words) + w)
            word_bounds = np.searchsorted(by_word, bounds)
            none = [pa.nulls(len(ids), pa.binary())] * 5
            sent_words = [_cut(words[w[by_word[:-1]]], word_bounds), *_cut_small(np.diff(by_word), word_bounds)]
            yield _batch(DEALT, pa.array(ids), pa.array(np.full(len(ids), batch)), *sent_words, _cut(_narrow(words[u] >> NARROW), bounds), *_cut_small(n, bounds), *none)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, header.schema) as out:
                out.write_table(header)
            own = [_planes(at), sink.getvalue().to_pybytes(), _planes(gw), _planes(split + 1), _planes(pieces)]
            yield _batch(DEALT, pa.array([-1 - batch]), pa.array([batch]), *[pa.nulls(1, pa.binary())] * 6, *(pa.array([x], pa.binary()) for x in own))

    return run


def _refs(places: np.ndarray, lengths: list[int], top: int) -> bytes:
    """Places below top that grow within each run (0: none), as steps."""
    return _planes(np.diff(np.maximum.accumulate(places + np.repeat(np.arange(len(lengths)) * top, lengths)), prepend=0))


def _places(data: bytes, lengths: np.ndarray, top: int) -> np.ndarray:
    step = _from_planes(data)
    first = np.zeros(len(step), bool)
    first[np.cumsum(lengths) - lengths] = True
    return np.where((step > 0) | first, np.cumsum(step) - np.repeat(np.arange(len(lengths)) * top, lengths), 0)


TOTALS = ("n_all", "v_all", "n1", "n2", "dishes", "dishes1", "dishes2")
PAIRS = "g long, w binary, reps binary, n binary, cu binary, of binary, single binary, customers binary"
ASKED = "batches binary, pairs binary, words binary, pair_refs binary, word_refs binary"
OWN = "batch long, tokens binary, header binary, gw binary, split binary, pieces binary"
HELD = f"{PAIRS}, total binary, {', '.join(f'{x} long' for x in TOTALS)}, {ASKED}, {OWN}"


def _merge(sent):
    """A group's pairs that occur in training, in order of word and context, with their counts; its
    contexts with their dishes seen once, customers and tables (as many as dishes at first); and where
    the runs' pairs and words are among its own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.g.iloc[0] < 0:
            return _frame(HELD, {k: pdf[k] for k in ("g", *_names(OWN))})
        pdf = pdf.sort_values("batch")
        said, u, n = np.frombuffer(b"".join(pdf.w), np.uint64), _wide(b"".join(pdf.u)), _small(pdf.n, pdf.n_large)
        n_words, n_pairs = [len(x) // 8 for x in pdf.w], [len(x) // CONTEXT_BYTES for x in pdf.u]
        w, word = np.unique(said, return_inverse=True)
        at = np.repeat(word, _small(pdf.reps, pdf.reps_large))
        if len(w) <= 1 << 16:
            key = (at.astype(np.uint64) << np.uint64(48)) | u
        else:
            every, key = np.unique(u, return_inverse=True)
            key = at * len(every) + key
        key, first, back = np.unique(key, return_index=True, return_inverse=True)
        total = np.bincount(back, n, len(key)).astype(np.int64)
        c, known = np.bincount(at[first], total, len(w)).astype(np.int64), total > 0
        there, place = c > 0, np.where(known, np.cumsum(known), 0)
        refs = [_refs(place[back], n_pairs, int(known.sum()) + 1), _refs(np.where(there, np.cumsum(there), 0)[word], n_words, int(there.sum()) + 1)]
        w, at, u, n = w[there], (np.cumsum(there) - 1)[at[first][known]], u[first][known], total[known]
        cu, of = np.unique(u, return_inverse=True)
        reps, whole = np.bincount(at, minlength=len(w)), sent.value.split_id(w) < 0
        sums = [n.sum(), whole.sum(), (n == 1).sum(), (n == 2).sum(), len(n), (reps[whole] == 1).sum(), (reps[whole] == 2).sum()]
        contexts = [np.bincount(of, n == 1, len(cu)), np.bincount(of, n, len(cu)), np.bincount(of, minlength=len(cu))]
        out = {"g": pdf.g.iloc[0], "w": w.tobytes(), "reps": _planes(reps), "n": _planes(n), "cu": _steps(cu), "of": _planes(of[n > 1])}
        out |= dict(zip(("single", "customers", "total"), (_planes(x.astype(np.int64)) for x in contexts), strict=True)) | {k: int(x) for k, x in zip(TOTALS, sums, strict=True)}
        out |= dict(zip(_names(ASKED), (pdf.batch.to_numpy(np.int64).tobytes(), _planes(np.array(n_pairs)), _planes(np.array(n_words)), *refs), strict=True))
        return _frame(HELD, {k: [x] for k, x in out.items()})

    return run


def _split_counts(sent):
    """(id, c, dishes): a group's part of the words that are split."""

    def run(batches):
        for t in batches:
            for x in t.to_pylist():
                own, reps, n = sent.value.split_id(np.frombuffer(x["w"], np.uint64)), _from_planes(x["reps"]), _from_planes(x["n"])
                c, some = np.bincount(np.repeat(np.arange(len(reps)), reps), n, len(reps)).astype(np.int64), own >= 0
                yield _batch("id long, c long, dishes long", *(pa.array(v[some]) for v in (own, c, reps)))

    return run


SENT = "o long, g long, u binary, total binary, total_large binary, c binary, c_large binary"


def _send(sent, keep):
    """Each group's contexts to the groups of their words, with `keep` numbers of tables, and their customers."""

    def run(batches):
        for t in batches:
            for x in t.to_pylist():
                u, total, c = _from_steps(x["cu"]), _from_planes(x["total"]).reshape(keep, -1).T, _from_planes(x["customers"])
                o = sent.value.of_context(u)
                order = np.argsort(o, kind="stable")
                ids, bounds = _bounds(o[order])
                yield _batch(SENT, pa.array(ids), pa.array(np.full(len(ids), x["g"])), _cut(_narrow(u[order]), bounds), *_cut_small(total[order].ravel(), bounds * keep), *_cut_small(c[order], bounds))

    return run


TOLD = "g long, o long, ids binary, total binary, total_large binary, customers binary"


def _totals(keep, reply):
    """A row (o < 0) of a group's contexts with the sums of their tables and customers; with `reply`, each
    group that sent some is told the first sum in the order in which it sent them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total, c = _small(pdf.total, pdf.total_large).reshape(-1, keep), _small(pdf.c, pdf.c_large)
        ids, back = np.unique(_wide(b"".join(pdf.u)), return_inverse=True)
        sums = np.array([np.bincount(back, x, len(ids)) for x in (*total.T, c)]).astype(np.int64)
        rows = [(pdf.o.iloc[0], -1, _steps(ids), _planes(sums[:-1].ravel()), None, _planes(sums[-1]))]
        if reply:
            bounds = np.append(0, np.cumsum([len(x) // CONTEXT_BYTES for x in pdf.u]))
            rows += zip(pdf.g, pdf.o, [None] * len(pdf), *(x.to_pylist() for x in _cut_small(sums[0][back], bounds)), [None] * len(pdf), strict=True)
        return pd.DataFrame(rows, columns=_names(TOLD))

    return run


def _log_gamma(x: np.ndarray) -> np.ndarray:
    low = np.maximum(0.0, np.ceil(8.0 - x))
    y, rise = x + low, np.ones_like(x)
    for k in range(int(low.max(initial=0))):
        rise *= np.where(k < low, x + k, 1.0)
    r = 1 / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + r * (1 / 12 - r * r * (1 / 360 - r * r / 1260)) - np.log(rise)


def _seat_one(c, j, weight, step, tables, logz, discount, rng):
    while j < c:
        new, old = weight + step * tables, j - discount * tables
        share = rng.betavariate(new, old)
        gap = math.log(1.0 - rng.random()) / math.log1p(-share) if 0.0 < share < 1.0 else (c if share <= 0.0 else 0.0)
        end = min(c, j + math.floor(min(gap, c)))
        logz += math.lgamma(end - discount * tables + new) - math.lgamma(old + new)
        if end < c:
            logz += math.log(end - discount * tables + new)
            tables += 1
        j = end + 1
    return tables, logz


def seat(c: np.ndarray, discount: float, weight: np.ndarray, step: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """A seating of c customers of one dish, for each row: its number of tables, and the log of the
    product of the customers' normalisers. At t tables of the dish a new one has weight + step * t,
    against the customers seated less discount * t. The run of customers up to the next new table is
    geometric with a beta chance: one draw a table, at any count."""
    t, z = np.minimum(c, 1).astype(float), np.zeros(len(c))
    at = (c > 1).nonzero()[0]
    c, j, weight, step = c[at].astype(float), np.ones(len(at)), weight[at], step[at]
    tables, logz = np.ones(len(at)), np.zeros(len(at))
    while len(at):
        if len(at) < 24:  # a few rows with many tables: the same draws, a row at a time
            for k, *row in zip(at.tolist(), c.tolist(), j.tolist(), weight.tolist(), step.tolist(), tables.tolist(), logz.tolist(), strict=True):
                t[k], z[k] = _seat_one(*row, discount, random.Random(int(rng.integers(1 << 62))))
            break
        new = weight + step * tables
        old = j - discount * tables
        with np.errstate(all="ignore"):
            gap = np.floor(np.log(1.0 - rng.random(len(at))) / np.log1p(-rng.beta(new, old)))
        end = np.minimum(c, j + np.nan_to_num(gap, nan=0.0, posinf=np.inf))
        logz += _log_gamma(end - discount * tables + new) - _log_gamma(old + new)
        opens = end < c
        logz[opens] += np.log(end - discount * tables + new)[opens]
        tables = tables + opens
        j = end + 1
        done = j >= c
        if done.any():
            t[at[done]], z[at[done]] = tables[done], logz[done]
            left = ~done
            at, c, j, weight, step, tables, logz = (v[left] for v in (at, c, j, weight, step, tables, logz))
    return t, z


def _taken(old, old_z, new, new_z, rng):
    """The proposals that are taken, by the ratio of the normalisers; the first always is."""
    if old_z is None:
        return new, new_z
    take = np.log(rng.random(len(new))) < new_z - old_z
    return np.where(take, new, old), np.where(take, new_z, old_z)


def _parent(i, customers, tables, s_total=None, n_total=None):
    return (customers - i["d1"] * tables + (i["a1"] + i["d1"] * (i["s"] if s_total is None else s_total)) * i["base"]) / (i["a1"] + (i["n"] if n_total is None else n_total))


SEATED = f"{PAIRS}, total binary, t binary, t_sum binary, seated binary, tables binary"


def _seated(sent, burn, keep):
    """Reseats a group's pairs, given the totals of tables of their contexts: its last numbers of
    tables, their sums over `keep` sweeps, and for each of these sweeps the words' customers and
    tables in the parent and the contexts' tables."""

    def run(table: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(table):
            return _frame(SEATED, {"g": []})
        i, where = sent.value
        row = table.iloc[0]
        words, reps, n, cu, of, first = np.frombuffer(row.w, np.uint64), _from_planes(row.reps), _from_planes(row.n), _from_steps(row.cu), _from_planes(row.of), _from_planes(row.single)
        at, more = np.repeat(np.arange(len(words)), reps), n > 1
        rng = np.random.Generator(np.random.PCG64([int(row.g), burn]))
        single = np.bincount(at[~more], minlength=len(words)).astype(float)
        a, c = at[more], n[more]
        told, total = told.sort_values("o"), np.zeros(len(cu))
        total[np.argsort(where.of_context(cu), kind="stable")] = _small(told.total, told.total_large)
        total = total[of]
        split = where.split_id(words)
        p_split = i["p_split"][split]
        t, z = (np.ones(len(c)) if row.t is None else _from_planes(row.t).astype(float)), None
        others = np.maximum(0.0, total - t)
        customers = single + np.bincount(a, t, len(words))
        s, sz, seen = np.minimum(customers, 1.0), None, None
        kept, t_sum = [], np.zeros(len(c))
        for k in range(burn + keep):
            rest = customers[a] - t  # a pair's own tables are no evidence for it
            p = np.where(split[a] >= 0, p_split[a], _parent(i, rest, np.minimum(s[a], rest)))
            t, z = _taken(t, z, *seat(c, i["d2"], (i["a2"] + i["d2"] * others) * p, i["d2"] * p, rng), rng)
            customers = single + np.bincount(a, t, len(words))
            weight = (i["a1"] + i["d1"] * np.maximum(0.0, i["s"] - s)) * i["base"]
            new, new_z = seat(np.where(split >= 0, 0.0, customers), i["d1"], weight, np.full(len(words), i["d1"] * i["base"]), rng)
            if sz is not None:
                sz = np.where(seen == customers, sz, -np.inf)  # other customers: there is no seating to keep
            s, sz = _taken(s, sz, new, new_z, rng)
            seen = customers
            if k >= burn:
                t_sum += t
                kept.append((first + np.bincount(of, t, len(cu)), customers, s))
        out = {"t": t, "t_sum": t_sum} | {k: np.concatenate([x[j] for x in kept]) for j, k in enumerate(("total", "seated", "tables"))}
        return _frame(SEATED, {k: [row[k]] for k in _names(PAIRS)} | {k: [_planes(v)] for k, v in out.items()})

    return run


def _sums(sent, keep):
    """(id, c0, ..., s0, ...): each group's customers and tables in the parent, of each split word and (null) of all other words."""
    names = [f"{x}{k}" for x in "cs" for k in range(keep)]

    def run(batches):
        for t in batches:
            for x in t.to_pylist():
                own, both = sent.value.split_id(np.frombuffer(x["w"], np.uint64)), [*_from_planes(x["seated"]).reshape(keep, -1), *_from_planes(x["tables"]).reshape(keep, -1)]
                some = own >= 0
                yield pa.RecordBatch.from_arrays([pa.array([*own[some].tolist(), None], pa.int64()), *(pa.array(np.append(v[some], v[~some].sum())) for v in both)], names=["id", *names])

    return run


def _grid(d: float):
    """The contexts' log likelihood of (tables, customers) at each concentration of the grid."""

    def run(batches):
        for t in batches:
            for row in t.to_pylist():
                pair, n = np.unique(np.stack([_from_planes(row["total"]), _from_planes(row["customers"])]), axis=1, return_counts=True)
                tables, c = pair.astype(float)
                value = [float(n @ (_log_gamma(x / d + tables) - _log_gamma(x + c))) + n.sum() * float((_log_gamma(np.array([x])) - _log_gamma(np.array([x / d])))[0]) for x in GRID]
                yield _batch("x int, value double", pa.array(np.arange(len(GRID), dtype=np.int32)), pa.array(value, pa.float64()))

    return run


def _drawn(value: np.ndarray, rng) -> float:
    p = np.exp(value - value.max())
    return float(rng.choice(GRID, p=p / p.sum()))


def _split_tables(sent):
    """(id, t0, ...): the tables of the split words' restaurants in each sample."""

    def run(batches):
        split = sent.value.split >> NARROW
        for t in batches:
            for x in t.to_pylist():
                ids, total = _from_steps(x["ids"]), _from_planes(x["total"]).reshape(SAMPLES, -1)
                at = np.minimum(np.searchsorted(ids, split), len(ids) - 1)
                some = (ids[at] == split).nonzero()[0]
                yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(v[at[some]]) for v in total)], names=["id", *(f"t{k}" for k in range(SAMPLES))])

    return run


ANSWER = f"g long, n binary, n_large binary, t_sum binary, t_sum_large binary, facts binary, facts_large binary, {OWN}"


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each run's pairs their counts and, if above one, tables summed over the samples; for its words
    their counts and, in each sample, their customers and tables in the parent and their own restaurant's tables."""
    parts = {k: next((x for x in pdf.itertuples() if getattr(x, k) is not None), None) for k in ("w", "t_sum", "ids")}
    held, seated, told = parts.values()
    if held is None:
        return _frame(ANSWER, {"g": []})
    words, n, batches, n_pairs, n_words = np.frombuffer(held.w, np.uint64), _from_planes(held.n), np.frombuffer(held.batches, "<i8"), _from_planes(held.pairs), _from_planes(held.words)
    facts = np.zeros((len(words) + 1, 1 + 3 * SAMPLES), np.int64)
    facts[1:, 0] = np.bincount(np.repeat(np.arange(len(words)), _from_planes(held.reps)), n, len(words))
    for k, v in enumerate((seated.seated, seated.tables)):
        facts[1:, 1 + k * SAMPLES : 1 + (k + 1) * SAMPLES] = _from_planes(v).reshape(SAMPLES, -1).T
    if told is not None:
        at, known = _found(_from_steps(told.ids), words >> NARROW)
        facts[1:, 1 + 2 * SAMPLES :][known] = _from_planes(told.total).reshape(SAMPLES, -1).T[at[known]]
    t_sum = np.full(len(n), SAMPLES)
    t_sum[n > 1] = _from_planes(seated.t_sum)
    at = _places(held.pair_refs, n_pairs, len(n) + 1)
    n, t_sum, bounds = np.append(0, n)[at], np.append(0, t_sum)[at], np.append(0, np.cumsum(n_pairs))
    facts = facts[_places(held.word_refs, n_words, len(words) + 1)]
    cut = [*_cut_small(n, bounds), *_cut_small(t_sum[n > 1], np.append(0, np.cumsum(n > 1))[bounds]), *_cut_small(facts.ravel(), np.append(0, np.cumsum(n_words)) * facts.shape[1])]
    return _frame(ANSWER, {"g": np.full(len(batches), held.g), "batch": batches} | {k: x.to_pylist() for k, x in zip(_names(ANSWER)[1:7], cut, strict=True)})


def _found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: where each asked one is, and whether it is."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _gather(sent):
    """A run's answers put beside its tokens, and summed by text."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i = sent.value
        own, told = pdf[pdf.g < 0].iloc[0], pdf[pdf.g >= 0].sort_values("g")
        header = pa.ipc.open_stream(own.header).read_all()
        lengths = header.column("n_tokens").to_numpy()
        at, gw, split = _from_planes(own.tokens), _from_planes(own.gw), _from_planes(own.split) - 1
        pairs, back = np.unique(_pairs(at, lengths, len(gw), at[lengths[0] - 1]), return_inverse=True)
        w, u = pairs // len(gw), pairs % len(gw)
        g = gw[w]
        g[split[w] >= 0] = _from_planes(own.pieces)
        order = np.argsort(g, kind="stable")
        _, by_word = _bounds(g[order] * len(gw) + w[order])  # as the run was dealt
        n, facts = _small(told.n, told.n_large), np.zeros((len(gw), 1 + 3 * SAMPLES))
        t_sum = np.where(n == 1, SAMPLES, 0)
        t_sum[n > 1] = _small(told.t_sum, told.t_sum_large)
        facts[w[order][by_word[:-1]]] = _small(told.facts, told.facts_large).reshape(-1, facts.shape[1])
        facts[split >= 0] = i["split"][split[split >= 0]]
        c, c_k, s_k, t_k = facts[:, 0], *(facts[:, 1 + k * SAMPLES : 1 + (k + 1) * SAMPLES] for k in range(3))
        parent, left = _parent(i, c_k, s_k, i["s_k"], i["n_k"]), (i["a2"] + i["d2"] * t_k) / (i["a2"] + c)[:, None]
        own_part = np.empty(len(pairs))
        own_part[order] = n - i["d2"] * t_sum / SAMPLES
        prob = (parent[w] * left[u]).sum(1) / SAMPLES + own_part / (i["a2"] + c[u])
        base = np.log10((c + 0.5) / (i["N"] + 0.5 * (i["V"] + 1)))
        ends = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        sums = [np.add.reduceat(v, ends) for v in ((c > 0).astype(np.int64)[at], base[at], np.log10(prob)[back])]
        return pd.DataFrame({
            "doc_id": header.column("doc_id").to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get), "held_out": header.column("held_out").to_pandas(), "n_tokens": lengths, "n_known": sums[0],
            "train_tokens": np.full(len(lengths), i["N"]), "base_score": sums[1], "score": sums[2],
        })

    return run


def score_texts(docs: DataFrame, held: Column, burn: int = BURN, group: int = GROUP) -> DataFrame:
    """The contract's columns, a row per document; learned from the documents outside `held`."""
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    rng = np.random.Generator(np.random.PCG64(11))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"))
    some = rows.where("not held_out").select("text").where(F.pmod(F.xxhash64("text"), F.lit(SHARE)) == 0).mapInArrow(_frequent, "w long, n long").groupBy("w").agg((F.sum("n") * SHARE).alias("n"))
    found = {r.w: r.n for r in some.orderBy(F.desc("n")).limit(WIDE).collect()}
    total = found.pop(None, 0)
    often = sorted((w % (1 << 64), n) for w, n in found.items() if n > max(group, total // WIDE))
    split = np.array([w for w, _ in often], np.uint64)
    where = send(_Groups(max(48, total // group), split, np.array([-(-n // group) for _, n in often], np.uint64)))
    held_rows = stored(rows.mapInArrow(_deal(where), DEALT).groupBy("g").applyInPandas(_merge(where), HELD), TEXTS)
    table = held_rows.where("g >= 0")
    whole = table.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in TOTALS)).first()
    at_first = np.zeros((len(split), 2))  # the split words' counts, and customers in the parent
    for r in table.select("w", "reps", "n").mapInArrow(_split_counts(where), "id long, c long, dishes long").groupBy("id").agg(F.sum("c").alias("c"), F.sum("dishes").alias("dishes")).collect() if len(split) else ():
        at_first[r.id] = r.c, r.dishes
    discount = lambda a, b: min(0.95, max(0.05, a / max(1.0, a + 2 * b)))
    v = int(whole.v_all) + int((at_first[:, 0] > 0).sum())
    d1, d2 = (discount(a + (at_first[:, 1] == 1).sum() * k, b + (at_first[:, 1] == 2).sum() * k) for a, b, k in ((whole.dishes1, whole.dishes2, 1), (whole.n1, whole.n2, 0)))
    info = {"N": int(whole.n_all), "V": v, "base": 1 / (v + 1), "d1": d1, "d2": d2, "a1": 1.0, "a2": 1.0, "s": float(v), "n": float(whole.dishes)}
    info["p_split"] = np.append(_parent(info, at_first[:, 1], np.minimum(at_first[:, 1], 1.0)), 0.0)  # the last: the place of -1
    state = table.select(*_names(PAIRS), "total", F.lit(None).cast("binary").alias("t"))
    told = _exchange(state, where, 1, True)
    for keep in (1, SAMPLES):
        state = stored(state.select(*_names(PAIRS), "t").groupBy("g").cogroup(told.where("o >= 0").select("g", "o", "total", "total_large").groupBy("g")).applyInPandas(_seated(send((info, where.value)), burn, keep), SEATED))
        names = [f"{x}{k}" for x in "cs" for k in range(keep)]
        parts, c_split = np.zeros(2 * keep), np.zeros((len(split), keep))
        for r in state.select("w", "seated", "tables").mapInArrow(_sums(where, keep), "id long, " + ", ".join(f"{x} long" for x in names)).groupBy("id").agg(*(F.sum(x).alias(x) for x in names)).collect():
            parts += [r[x] for x in names]
            if r.id is not None:
                c_split[r.id] = [r[x] for x in names[:keep]]
        step = info["d1"] * info["base"]
        s_split = np.array([seat(c, info["d1"], np.full(len(c), (info["a1"] + info["d1"] * info["s"]) * info["base"]), np.full(len(c), step), rng)[0] for c in c_split.T]).reshape(keep, -1).T
        n_k, s_k = parts[:keep], parts[keep:] + s_split.sum(0)
        info = info | {"s_k": s_k, "n_k": n_k, "s": float(s_k.mean()), "n": float(n_k.mean())}
        told = stored(_exchange(state, where, keep, keep == 1))
        if keep == 1:  # concentrations for the next pass, given this one's seatings
            fit = told.where("o < 0").select("total", "customers").mapInArrow(_grid(info["d2"]), "x int, value double").groupBy("x").agg(F.sum("value").alias("value")).collect()
            if fit:
                info["a2"] = _drawn(np.array([r.value for r in sorted(fit, key=lambda r: r.x)]), rng)
                info["a1"] = _drawn(_log_gamma(GRID / info["d1"] + info["s"]) - _log_gamma(GRID / info["d1"]) - _log_gamma(GRID + info["n"]) + _log_gamma(GRID), rng)
            info["p_split"] = np.append(_parent(info, c_split[:, 0], s_split[:, 0]), 0.0)
            first = state, told
    seated = stored(state.select("g", "t_sum", "seated", "tables"))  # all that is left to ask of the seatings
    for x in (*first, state):
        drop_stored(x)
    t_split = np.zeros((len(split), SAMPLES))
    for r in told.select("ids", "total").mapInArrow(_split_tables(where), "id long, " + ", ".join(f"t{k} long" for k in range(SAMPLES))).collect() if len(split) else ():
        t_split[r.id] = r[1:]
    info["split"] = np.hstack([at_first[:, :1], c_split, s_split, t_split])
    known = [table.select("g", "w", "reps", "n", *_names(ASKED)), seated, told.select("g", "ids", "total")]
    known = known[0].unionByName(known[1], allowMissingColumns=True).unionByName(known[2], allowMissingColumns=True)
    answers = known.groupBy("g").applyInPandas(_answer, ANSWER)
    own = held_rows.where("g < 0").select("g", *_names(OWN))
    return answers.unionByName(own, allowMissingColumns=True).groupBy("batch").applyInPandas(_gather(send(info)), SCORES)


def _exchange(state: DataFrame, where, keep: int, reply: bool) -> DataFrame:
    return state.select("g", "cu", "total", "customers").mapInArrow(_send(where, keep), SENT).groupBy("o").applyInPandas(_totals(keep, reply), TOLD)


def lm_score(docs: DataFrame, folds: int = 5, fold: int = 1) -> DataFrame:
    return score_texts(docs, crc_mod(F.col("doc_id"), folds) == fold)

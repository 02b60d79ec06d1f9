"""Text probabilities from a small causal self-attention model over subwords, beside a unigram base over words."""

from __future__ import annotations

import base64
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.llm import text as T
from tablecraft.llm.columns import kind, training_row, whole
from tablecraft.llm.storage import cut, most_frequent

PARTS, HELD = 7, 2
#: Words whose counts are broadcast (a fixed number of the most frequent); all others meet their counts in a join.
HOT_WORDS = 200_000
#: Passages of all training texts that the network's weights start from, at most, and their characters; steps, windows a step.
SAMPLE, PASSAGE, STEPS, BATCH = 1_600, 2_000, 400, 48
#: Then all chunks of ROW windows of the whole corpus train copies of the network, a copy for about GROUP chunks; rate of a step.
ROW, GROUP, RATE = 10, 16_000, 0.01
#: Frequent subwords that tell classes apart as neighbours, counted over all training texts; subwords of a block of rows that travel together.
MARKS, BLOCK = 128, 1 << 10
#: Context window; a later window repeats OVERLAP positions as context and scores the rest.
LENGTH, OVERLAP, WIDTH, CLASSES = 48, 16, 24, 64
PIECE_CHARS = 1 << 16
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_WORD = np.uint64(0x5EED0FE4D)  # stands for the end of a text among word hashes


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(path: str):
    """(text -> ids, number of ids without the end mark) of a tiktoken rank file; the end mark is the next free id."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if len(text) <= PIECE_CHARS:
            return np.array(coder.encode_ordinary(text), np.int32)
        out, i = [], 0
        while i < len(text):  # between a word and the blank before the next one no subword is cut
            j = min(len(text), i + PIECE_CHARS)
            if j < len(text) and (at := text.rfind(" ", i + 1, j)) > i and not text[at - 1].isspace() and not text[at + 1].isspace():
                j = at
            out.append(np.array(coder.encode_ordinary(text[i:j]), np.int32))
            i = j
        return np.concatenate(out)

    return encode, max(ranks.values()) + 1


@dataclass
class Attention:
    """One causal self-attention layer that predicts the class of the next subword; the subword follows from its class by frequency."""

    p: dict[str, np.ndarray]
    class_of: np.ndarray
    log_share: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log10 of a subword's share of its class
    joined: np.ndarray | None = None
    joined_place: np.ndarray | None = None
    seen: np.ndarray | None = None

    def forward(self, ids: np.ndarray):
        p, n = self.p, ids.shape[1]
        x = p["embed"][ids] + p["place"][:n]
        q, k, v = x @ p["q"], x @ p["k"], x @ p["v"]
        s = q @ k.transpose(0, 2, 1)
        s *= np.float32(WIDTH**-0.5)
        s += np.triu(np.full((n, n), -1e9, np.float32), 1)
        s -= s.max(2, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(2, keepdims=True)
        o = s @ v
        return x, q, k, v, s, o, x + o @ p["o"]

    def log10_class(self, ids: np.ndarray, position: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log10 probability of the class `target` after each chosen (window, place). The same network as `forward` in fewer passes: projections
        are looked up by subword and place, places before the first chosen one ask nothing, exponentials are safe within +-60, and sums
        divide the outputs instead of the weights."""
        p, n = self.p, ids.shape[1]
        first = int(np.argmax(position.any(0)))
        mixed = self.joined.take(ids, axis=0)
        mixed += self.joined_place[:n]
        q, k, v = mixed[:, first:, :WIDTH], mixed[..., WIDTH : 2 * WIDTH], mixed[..., 2 * WIDTH :]
        s = q @ k.transpose(0, 2, 1)
        np.clip(s, -60, 60, out=s)
        np.exp(s, out=s)
        s *= self.seen[first:n, :n]
        o = s @ v
        o /= s @ np.ones((n, 1), s.dtype)
        x = p["embed"].take(ids[:, first:], axis=0)
        x += p["place"][first:n]
        chosen = position[:, first:]
        if not chosen.all():
            o, x = o[chosen], x[chosen]
        h = o.reshape(-1, WIDTH) @ p["o"]
        h += x.reshape(-1, WIDTH)
        z = h @ p["out"]
        z += p["bias"]
        np.clip(z, -60, 60, out=z)
        picked = z[np.arange(len(z)), target].astype(np.float64)
        np.exp(z, out=z)
        return (picked - np.log((z @ np.ones(CLASSES, z.dtype)).astype(np.float64))) / np.log(10)

    def ready(self) -> "Attention":
        """Prepares scoring, once: the three projections of every subword and place side by side, the first scaled, and the mask of what a
        place may see."""
        if self.joined is None:
            joined = np.concatenate([self.p["q"] * np.float32(WIDTH**-0.5), self.p["k"], self.p["v"]], axis=1)
            self.joined, self.joined_place = self.p["embed"] @ joined, self.p["place"] @ joined
            self.seen = np.tril(np.ones((LENGTH, LENGTH), np.float32))
        return self

    def gradients(self, ids: np.ndarray, target: np.ndarray, weight: np.ndarray, runs: tuple | None = None) -> tuple[float, dict]:
        """Loss and gradients of the network of `forward`, in fewer passes: the three projections are one product, exponentials are safe
        within +-60, what the softmax of the attention takes off is a product of its outputs. `runs` are the places of `ids` in the order of their subwords and where each subword begins there, if known."""
        p, n, kind = self.p, ids.shape[1], self.p["q"].dtype
        flat = lambda m: m.reshape(-1, m.shape[-1])
        small = kind.type(WIDTH**-0.5)
        joined = np.concatenate([p["q"] * small, p["k"], p["v"]], axis=1)
        x = p["embed"].take(ids, axis=0)
        x += p["place"][:n]
        mixed = (flat(x) @ joined).reshape(*ids.shape, -1)
        q, k, v = mixed[..., :WIDTH], mixed[..., WIDTH : 2 * WIDTH], mixed[..., 2 * WIDTH :]
        a = q @ k.transpose(0, 2, 1)
        np.clip(a, -60, 60, out=a)
        np.exp(a, out=a)
        a *= np.tril(np.ones((n, n), kind))
        share = 1 / (a @ np.ones((n, 1), kind))
        o = a @ v
        o *= share
        h = flat(x) + flat(o) @ p["o"]
        soft = h @ p["out"]
        soft += p["bias"]
        np.clip(soft, -60, 60, out=soft)
        scale = (weight / max(weight.sum(), 1)).astype(kind).ravel()
        at = np.arange(len(soft)), target.ravel()
        picked = soft[at]
        np.exp(soft, out=soft)
        total = soft @ np.ones(CLASSES, kind)
        loss = float(((np.log(total) - picked) * scale).sum())
        soft *= (scale / total)[:, None]
        soft[at] -= scale
        dh = soft @ p["out"].T
        do = (dh @ p["o"].T).reshape(x.shape)
        do *= share
        ds = do @ v.transpose(0, 2, 1)
        ds -= np.einsum("bnw,bnw->bn", do, o)[..., None]
        ds *= a
        dmixed = np.empty((*ids.shape, 3 * WIDTH), kind)
        np.matmul(ds, k, out=dmixed[..., :WIDTH])
        np.matmul(ds.transpose(0, 2, 1), q, out=dmixed[..., WIDTH : 2 * WIDTH])
        np.matmul(a.transpose(0, 2, 1), do, out=dmixed[..., 2 * WIDTH :])
        dx = flat(dmixed) @ joined.T
        dx += dh
        place = np.zeros_like(p["place"])
        place[:n] = dx.reshape(x.shape).sum(0)
        order, first = runs or runs_of(ids.ravel())
        embed = np.zeros_like(p["embed"])
        embed[ids.ravel()[order[first]]] = np.add.reduceat(dx.take(order, axis=0), first, axis=0)
        dq, dk, dv = np.split(flat(x).T @ flat(dmixed), 3, axis=1)
        return loss, {
            "embed": embed, "place": place, "q": dq * small, "k": dk, "v": dv, "o": flat(o).T @ dh, "out": h.T @ soft, "bias": soft.sum(0),
        }


def runs_of(read: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of `read` in the order of its values, equal ones as they come, and where in that order each value begins."""
    order = np.argsort(read, kind="stable")
    ranked = read[order]
    return order, np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])


def beside(texts: list[np.ndarray], marks: np.ndarray, vocabulary: int, table: np.ndarray | None = None) -> np.ndarray:
    """Adds to a vocabulary x 2 (MARKS + 1) table how often each mark, or another subword, stands before and after each subword."""
    table = np.zeros((vocabulary, 2 * (MARKS + 1)), np.int32) if table is None else table
    width = table.shape[1]
    kind = np.int32 if vocabulary * width < 1 << 31 else np.int64
    mark_of = np.full(vocabulary, MARKS, kind)
    mark_of[marks] = np.arange(len(marks))
    flow = np.concatenate(texts).astype(kind) if texts else np.zeros(0, kind)
    within = np.ones(max(0, len(flow) - 1), bool)
    edges = np.cumsum([len(t) for t in texts])[:-1] if texts else np.zeros(0, np.int64)
    within[edges[(edges > 0) & (edges < len(flow))] - 1] = False
    mark, row = mark_of[flow], flow * kind(width)
    cells = np.concatenate([(row[1:] + mark[:-1])[within], (row[:-1] + mark[1:] + kind(MARKS + 1))[within]])
    cells.sort()  # the table is larger than the caches
    first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]][: len(cells)])
    table.reshape(-1)[cells[first]] += np.diff(first, append=len(cells)).astype(np.int32)
    return table


def marks_of(count: np.ndarray) -> np.ndarray:
    return np.argsort(-count, kind="stable")[:MARKS]


def clustered(known: np.ndarray, shares: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Classes by k-means over the shares of neighbours (their roots) of the `known` subwords; all others are spread evenly."""
    out = np.arange(len(count)) % CLASSES
    k = min(CLASSES, len(known))
    if not k:
        return out
    heaviest = np.argsort(-count[known], kind="stable")[:k]
    centre = shares[heaviest].copy()
    weight = count[known].astype(np.float64) ** 0.5
    for _ in range(12):
        near = (shares @ centre.T).argmax(1)
        for c in range(k):
            if (mine := near == c).any():
                centre[c] = np.average(shares[mine], axis=0, weights=weight[mine])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
    out[known] = near
    return out


def classes(texts: list[np.ndarray], vocabulary: int, rng) -> np.ndarray:
    """Classes of subwords by what stands beside them in `texts`; those seen less than 5 times are spread evenly."""
    count = np.bincount(np.concatenate(texts), minlength=vocabulary) if texts else np.zeros(vocabulary, np.int64)
    if count.sum() < 200:
        return np.arange(vocabulary) % CLASSES
    known = np.flatnonzero(count >= 5)
    table = beside(texts, marks_of(count), vocabulary)[known].astype(np.float32)
    return clustered(known, np.sqrt(table / np.maximum(table.sum(1, keepdims=True), 1)), count)


def train(texts: list[np.ndarray], vocabulary: int, steps: int = STEPS, batch: int = BATCH, seed: int = 5, class_of: np.ndarray | None = None) -> Attention:
    """Adam over random windows of the given subword sequences, each between end marks (id vocabulary - 1). Without `class_of` the classes
    come from the same sequences."""
    keep_heap()
    rng = np.random.default_rng(seed)
    normal = lambda *shape, by=0.1: (rng.standard_normal(shape) * by).astype(np.float32)
    end = vocabulary - 1
    model = Attention({
        "embed": normal(vocabulary, WIDTH), "place": normal(LENGTH, WIDTH, by=0.02), "q": normal(WIDTH, WIDTH, by=0.2), "k": normal(WIDTH, WIDTH, by=0.2),
        "v": normal(WIDTH, WIDTH, by=0.2), "o": normal(WIDTH, WIDTH, by=0.2), "out": normal(WIDTH, CLASSES, by=0.2), "bias": np.zeros(CLASSES, np.float32),
    }, classes(texts, vocabulary, rng) if class_of is None else class_of)
    if not texts:
        return model
    flow = np.concatenate([np.r_[end, t] for t in texts] + [[end]])
    if len(flow) < 4:
        return model
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    length = min(LENGTH, len(flow) - 1)
    for step in range(1, steps + 1):
        at = rng.integers(0, len(flow) - length, batch)[:, None] + np.arange(length)
        _, g = model.gradients(flow[at], model.class_of[flow[at + 1]], np.ones(at.shape))
        rate = 0.02 * min(1, step / 20) * (1 - 0.9 * step / steps)
        for name, d in g.items():
            first[name] += 0.1 * (d - first[name])
            second[name] += 0.01 * (d * d - second[name])
            model.p[name] -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def keep_heap() -> None:
    """Lets the C library keep what arrays of up to 31 MB leave: it does so up to the largest array that was freed, and otherwise every step
    takes its arrays' pages from the system anew. Changes no result."""
    np.empty(31 << 20, np.uint8)


def windows_of(chunks: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, next ids, weights) of windows of LENGTH that hold every step of the given chunks once; weight 0 where a chunk is over."""
    kind = np.uint16 if end < 1 << 16 else np.int32  # short numbers sort faster
    ids, following, weight = [], [], []
    for c in chunks:
        steps = len(c) - 1
        rows = -(-steps // LENGTH)
        pad = rows * LENGTH - steps
        filled = np.full(pad, end, kind)
        ids.append(np.concatenate([c[:-1], filled], dtype=kind, casting="unsafe").reshape(rows, LENGTH))
        following.append(np.concatenate([c[1:], filled], dtype=kind, casting="unsafe").reshape(rows, LENGTH))
        weight.append((np.arange(rows * LENGTH) < steps).astype(np.float32).reshape(rows, LENGTH))
    return np.concatenate(ids), np.concatenate(following), np.concatenate(weight)


def refined(model: Attention, chunks: list[np.ndarray], vocabulary: int, seed: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Weights after one pass of Adam over all the chunks, and how often each subword was read. Only rows of subwords in a step move."""
    keep_heap()
    rng = np.random.default_rng(seed)
    ids, following, weight = windows_of(chunks, vocabulary - 1)
    rest = [k for k in model.p if k != "embed"]
    flat = np.concatenate([model.p[k].ravel() for k in rest])
    state = flat, np.zeros_like(flat), np.zeros_like(flat)  # weights, mean gradients, mean squares
    ends = np.cumsum([model.p[k].size for k in rest])
    small = Attention({k: part.reshape(model.p[k].shape) for k, part in zip(rest, np.split(flat, ends[:-1]))}, model.class_of)  # views
    embed = np.concatenate([model.p["embed"], np.zeros((vocabulary, 2 * WIDTH), np.float32)], axis=1)  # the same three of a subword side by side
    order = rng.permutation(len(ids))
    steps = -(-len(order) // BATCH)

    def moved(w, mean, square, d, step, rate):
        mean *= np.float32(0.9)
        mean += np.float32(0.1) * d
        square *= np.float32(0.99)
        part = np.float32(0.01) * d
        part *= d
        square += part
        root = np.sqrt(square / np.float32(1 - 0.99**step))
        root += np.float32(1e-7)
        np.multiply(mean, np.float32(rate / (1 - 0.9**step)), out=part)
        part /= root
        w -= part

    for step in range(1, steps + 1):
        at = order[(step - 1) * BATCH : step * BATCH]
        read = ids[at].ravel()
        places, first = runs_of(read)
        rows = read[places[first]]
        inner = np.empty(len(read), np.intp)
        inner[places] = np.repeat(np.arange(len(rows)), np.diff(first, append=len(read)))
        mine = embed.take(rows, axis=0)
        small.p["embed"] = np.ascontiguousarray(mine[:, :WIDTH])
        _, g = small.gradients(inner.reshape(len(at), LENGTH), model.class_of[following[at]], weight[at], (places, first))
        rate = RATE * min(1, step / 20) * (1 - 0.9 * step / steps)
        moved(*state, np.concatenate([g[k].ravel() for k in rest]), step, rate)
        moved(*np.split(mine, 3, axis=1), g["embed"], step, rate)
        embed[rows] = mine
    return small.p | {"embed": embed[:, :WIDTH].copy()}, np.bincount(ids[weight > 0], minlength=vocabulary)


def window_scores(model: Attention, sequences: list[np.ndarray], vocabulary: int, block: int = 96) -> np.ndarray:
    """log10 probability of each sequence and its end. Windows overlap; a position is scored in the first window that reaches it."""
    end, stride = vocabulary - 1, LENGTH - OVERLAP
    keep_heap()
    model.ready()
    totals = np.zeros(len(sequences))
    sizes = np.array([len(s) + 1 for s in sequences], np.int64)
    if not len(sizes):
        return totals
    at = np.concatenate([[0], np.cumsum(sizes)])
    given = np.full(at[-1], end, np.int64)
    wanted = np.full(at[-1], end, np.int64)
    for i, s in enumerate(sequences):
        given[at[i] + 1 : at[i + 1]] = s
        wanted[at[i] : at[i + 1] - 1] = s
    many = 1 + np.maximum(0, -(-(sizes - LENGTH) // stride))
    owner = np.repeat(np.arange(len(sizes)), many)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    order = np.lexsort((np.minimum(sizes[owner] - number * stride, LENGTH), number > 0))  # windows of like length together, later ones apart
    points = model.log_share[wanted].astype(np.float64)
    wanted_class = model.class_of[wanted]
    for lo in range(0, len(order), block):
        own, num = owner[order[lo : lo + block]], number[order[lo : lo + block]]
        left = sizes[own] - num * stride
        n = int(min(LENGTH, left.max()))
        place = np.arange(n)
        where = (at[own] + num * stride)[:, None] + np.minimum(place, left[:, None] - 1)
        scored = (place < left[:, None]) & ((num == 0)[:, None] | (place >= OVERLAP))
        spots = where[scored]
        points[spots] += model.log10_class(given[where], scored, wanted_class[spots])  # each position once
    return np.add.reduceat(points, at[:-1])


def word_counts(train_docs: DataFrame) -> DataFrame:
    """(h, n) over all training texts: occurrences of each word hash, with one end a text. A task adds up what it reads and hands on its
    sums whenever they pass a fixed number of words."""

    def count(batches):
        keys, sums, held = [], [], 0

        def merged():
            k, back = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(back, np.concatenate(sums)).astype(np.int64)

        def rows(k, n):
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(k).view(np.int64)), pa.array(n)], ["h", "n"])

        for batch in batches:
            for i, j, w in T.word_slices(batch.column(0), T.BLANK_WORDS, True):
                k, n = np.unique(w.hashes(), return_counts=True)
                keys += [k, np.array([END_WORD])]
                sums += [n, np.array([j - i])]
                held += len(k)
                if held > 4_000_000:
                    k, n = merged()
                    keys, sums, held = [k], [n], len(k)
                    if held > 2_000_000:
                        yield rows(k, n)
                        keys, sums, held = [], [], 0
        if keys:
            yield rows(*merged())

    return train_docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def coded(docs: DataFrame, vocabulary_path: str, vocabulary: int, hot=None) -> DataFrame:
    """(key, ids, n) of every text: its subwords as numbers of the narrowest kind, and how many.

    With `hot`, a broadcast of the hashes of frequent words in order and their counts, the same reading of the texts also gives doc_id,
    held_out, n_tokens, the number of frequent words (hot_known), the sum of their logarithms (hot_sum) and the hashes of all others (tail)."""
    number = np.uint16 if vocabulary <= 1 << 16 else np.int32

    def base(w, size):
        hot_h, hot_n = hot.value
        h = np.concatenate([w.hashes(), np.full(size, END_WORD)])
        doc = np.concatenate([w.doc, np.arange(size)])
        at = np.minimum(np.searchsorted(hot_h, h), max(0, len(hot_h) - 1))
        found = hot_h[at] == h if len(hot_h) else np.zeros(len(h), bool)
        sums = np.bincount(doc[found], np.log10(hot_n[at[found]] + 1.0) if found.any() else None, minlength=size).astype(np.float64)
        tail_doc, tail = doc[~found], h[~found]
        order = np.argsort(tail_doc, kind="stable")
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(tail_doc[order], np.arange(size + 1)), pa.int32()), pa.array(tail[order].view(np.int64)))
        return [pa.array(np.bincount(doc, minlength=size)), pa.array(np.bincount(doc[found], minlength=size)), pa.array(sums), lists]

    def code(batches):
        encode, _ = encoder(vocabulary_path)
        for batch in batches:
            for i, j, w in T.word_slices(batch.column(1), T.BLANK_WORDS, True):
                part = batch.slice(i, j - i)
                ids = [encode(t or "").astype(number) for t in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64())]
                if hot is not None:
                    columns += [part.column(2), part.column(3), *base(w, j - i)]
                yield pa.RecordBatch.from_arrays(columns, names)

    names, schema, more = ["key", "ids", "n"], "key long, ids binary, n long", []
    if hot is not None:
        names, more = [*names, "doc_id", "held_out", "n_tokens", "hot_known", "hot_sum", "tail"], ["doc_id", "held_out"]
        schema += f", doc_id {kind(docs)}, held_out boolean, n_tokens long, hot_known long, hot_sum double, tail array<long>"
    return docs.select(F.xxhash64("doc_id", "text").alias("key"), "text", *more).mapInArrow(code, schema)


def sequences_of(column: pa.Array, vocabulary: int, limit: int = 1 << 19):
    """Lists of subword sequences of about `limit` subwords together."""
    kind = np.uint16 if vocabulary <= 1 << 16 else np.int32
    got, held = [], 0
    for b in column.to_pylist():
        got.append(np.frombuffer(b, kind))
        held += len(got[-1])
        if held > limit:
            yield got
            got, held = [], 0
    if got:
        yield got


def subword_counts(codes: DataFrame, vocabulary: int) -> np.ndarray:
    """Occurrences of each subword id over all training texts, with one end a text."""

    def count(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for texts in sequences_of(batch.column(0), vocabulary):
                total += np.bincount(np.concatenate(texts), minlength=vocabulary)
            total[-1] += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    rows = codes.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # at most the vocabulary
    out = np.zeros(vocabulary, np.int64)
    out[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return out


def corpus_classes(codes: DataFrame, count: np.ndarray) -> np.ndarray:
    """Classes of subwords by their neighbours in all training texts. Tasks add up a table of fixed size and send its cells, Spark adds
    those up, and the driver gets one row a subword that occurs 5 times or more."""
    vocabulary, marks, width = len(count), marks_of(count[:-1]), 2 * (MARKS + 1)

    def cells(batches):
        table = np.zeros((vocabulary, width), np.int32)
        for batch in batches:
            for texts in sequences_of(batch.column(0), vocabulary):
                beside(texts, marks, vocabulary, table)
        flat = table.reshape(-1)
        at = np.flatnonzero(flat)
        for lo in range(0, len(at), 1 << 18):
            part = at[lo : lo + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(flat[part].astype(np.int64))], ["cell", "n"])

    def roots(group):
        at, n = group["cell"].to_numpy(), group["n"].to_numpy()
        rows, back = np.unique(at // width, return_inverse=True)
        shares = np.zeros((len(rows), width))
        shares[back, at % width] = n
        shares = np.sqrt(shares / shares.sum(1, keepdims=True)).astype(np.float16)
        kept = count[rows] >= 5
        return pa.table({"id": pa.array(rows[kept]), "shares": pa.array([x.tobytes() for x in shares[kept]], pa.binary())})

    summed = codes.select("ids").mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    got = summed.groupBy(F.floor(F.col("cell") / (width * BLOCK)).alias("block")).applyInArrow(roots, "id long, shares binary").toArrow()
    ids = got["id"].to_numpy()
    order = np.argsort(ids)
    shares = np.frombuffer(b"".join(got["shares"].to_pylist()), np.float16).reshape(-1, width)[order].astype(np.float32)
    return clustered(ids[order], shares, count)


def corpus_training(model: Attention, codes: DataFrame, vocabulary: int) -> Attention:
    """Trains copies of the network on all chunks of all training texts, and averages the copies in Spark.

    Chunks go to groups by their hash, so the copies do not depend on how rows are partitioned; the groups, and with them the copies,
    grow with the corpus. A subword's row is averaged by how often the copies read it, all other weights by the subwords read.
    """
    size, end = ROW * LENGTH, vocabulary - 1
    n_chunks = codes.agg(F.sum(F.ceil((F.col("n") + 1) / size))).first()[0]
    if not n_chunks:
        return model
    groups = max(1, -(-int(n_chunks) // GROUP))
    kind = np.uint16 if vocabulary <= 1 << 16 else np.int32
    shared = codes.sparkSession.sparkContext.broadcast(model)
    rest = [k for k in model.p if k != "embed"]

    def dealt(batches):
        mark = np.array([end], kind)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, got = batch.slice(lo, 256), []
                for key, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    flow = np.concatenate([mark, np.frombuffer(b, kind), mark])
                    h = T.mix(np.uint64(key % 2**64) + np.arange(-(-(len(flow) - 1) // size), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    got += [(int(x % np.uint64(groups)), int(x >> np.uint64(1)), flow[i * size : (i + 1) * size + 1].tobytes()) for i, x in enumerate(h)]
                columns = zip(*got)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], ["group", "h", "ids"])

    def learn(key, table):
        table = table.sort_by([("h", "ascending"), ("ids", "ascending")])
        model, number = shared.value, key[0].as_py()
        p, read = refined(model, [np.frombuffer(b, kind) for b in table["ids"].to_pylist()], vocabulary, number)
        at = np.flatnonzero(read)
        out = [(-1, number, np.array([0]), np.array([read.sum()]), np.concatenate([(p[k] - model.p[k]).ravel() for k in rest])[None])]
        for rows in np.split(at, np.flatnonzero(np.diff(at // BLOCK)) + 1):
            out.append((int(rows[0]) // BLOCK, number, rows, read[rows], p["embed"][rows] - model.p["embed"][rows]))
        return pa.table({
            "block": pa.array([r[0] for r in out], pa.int64()), "group": pa.array([r[1] for r in out], pa.int64()), "rows": pa.array([r[2].astype(np.int64).tobytes() for r in out], pa.binary()),
            "read": pa.array([r[3].astype(np.int64).tobytes() for r in out], pa.binary()), "change": pa.array([r[4].astype(np.float32).tobytes() for r in out], pa.binary()),
        })

    def average(key, table):
        first = max(0, key[0].as_py()) * BLOCK
        width = WIDTH if key[0].as_py() >= 0 else sum(model_sizes)
        total, weight = np.zeros((BLOCK if key[0].as_py() >= 0 else 1, width)), np.zeros(BLOCK if key[0].as_py() >= 0 else 1)
        table = table.sort_by("group")
        for r, n, c in zip(*(table[x].to_pylist() for x in ("rows", "read", "change"))):
            rows, read = np.frombuffer(r, np.int64) - first, np.frombuffer(n, np.int64)
            total[rows] += np.frombuffer(c, np.float32).reshape(len(rows), width) * read[:, None]
            weight[rows] += read
        kept = np.flatnonzero(weight)
        change = (total[kept] / weight[kept, None]).astype(np.float32)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "rows": pa.array([(kept + first).tobytes()], pa.binary()), "change": pa.array([change.tobytes()], pa.binary())})

    model_sizes = [model.p[k].size for k in rest]
    chunks = codes.select("key", "ids").mapInArrow(dealt, "group long, h long, ids binary")
    changes = chunks.groupBy("group").applyInArrow(learn, "block long, group long, rows binary, read binary, change binary")
    got = changes.groupBy("block").applyInArrow(average, "block long, rows binary, change binary").collect()  # one network
    p = {k: v.copy() for k, v in model.p.items()}
    for r in got:
        change = np.frombuffer(r["change"], np.float32)
        if r["block"] >= 0:
            rows = np.frombuffer(r["rows"], np.int64)
            p["embed"][rows] += change.reshape(len(rows), WIDTH)
        else:
            for k, part in zip(rest, np.split(change, np.cumsum(model_sizes)[:-1])):
                p[k] += part.reshape(p[k].shape)
    return Attention(p, model.class_of)


def sample_passages(train_docs: DataFrame, sample: int = SAMPLE, size: int = PASSAGE) -> list[str]:
    """At most about `sample` passages from anywhere in the training texts: those with the smallest hash of their row and number. Hashes
    alone find the largest that is taken; then only passages up to it leave their tasks."""

    def hashes(key: int, n_chars: int) -> np.ndarray:
        many = max(1, -(-n_chars // size))
        return T.mix(np.uint64(key % 2**64) + np.arange(many, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)

    def smallest(batches):
        for batch in batches:
            h = [hashes(k, n) for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.sort(np.concatenate(h))[:sample] if h else np.zeros(0, np.int64))], ["h"])

    keyed = train_docs.select(F.xxhash64("doc_id", "text").alias("key"), F.char_length("text").cast("long").alias("n"), "text")
    edge = keyed.select("key", "n").mapInArrow(smallest, "h long").distinct().orderBy("h").limit(sample).agg(F.max("h").alias("h")).first()["h"]
    if edge is None:
        return []

    def chosen(batches):
        for batch in batches:
            got = []
            for key, n, t in zip(*(c.to_pylist() for c in batch.columns)):
                h = hashes(key, n)
                got += [(int(h[i]), t[i * size : (i + 1) * size]) for i in np.flatnonzero(h <= edge).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string())], ["h", "passage"])

    rows = keyed.mapInArrow(chosen, "h long, passage string").distinct()  # repeated rows give a passage once
    return [r["passage"] for r in rows.orderBy("h", "passage").limit(sample).collect()]


def score_texts(docs: DataFrame, vocabulary_path: str | None = None, parts: int = PARTS, held: int = HELD, sample: int = SAMPLE, steps: int = STEPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of `docs` (doc_id, text, ...).

    Word counts, subword frequencies and the classes of subwords come from all training rows. The network's weights start from at most
    `sample` passages of them, those with the smallest hash, and are then trained on all training rows. A missing or empty text is its end
    alone. Rows that repeat doc_id and text get equal results each; a row without doc_id trains. With no training rows all counts are 0
    and the network is untrained, but scores are finite. Other columns of `docs` are not read.
    """
    path = vocabulary_path or default_vocabulary()
    encode, size = encoder(path)
    vocabulary = size + 1
    trains = training_row(F.col("doc_id"), parts, held)
    rows = docs.select("doc_id", whole(F.col("text")).alias("text"), (~trains).alias("held_out"))
    learning = rows.where(~F.col("held_out"))
    words = cut(word_counts(learning))
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("n").alias("v")).first()
    hot = most_frequent(words.select("h", "n"), HOT_WORDS, "h").toArrow()  # a fixed number of rows
    hot_h = hot["h"].to_numpy().view(np.uint64)
    order = np.argsort(hot_h)
    hot_h, hot_n = hot_h[order], hot["n"].to_numpy()[order]
    every = coded(rows, path, vocabulary, docs.sparkSession.sparkContext.broadcast((hot_h, hot_n)))
    every = cut(every.withColumn("row", F.monotonically_increasing_id()))  # written once, so a row keeps its number
    codes = every.where(~F.col("held_out")).select("key", "ids", "n")
    frequency = subword_counts(codes, vocabulary)
    model = train([encode(t) for t in sample_passages(learning, sample)], vocabulary, steps, class_of=corpus_classes(codes, frequency))
    model = corpus_training(model, codes, vocabulary)
    smooth = frequency + 0.5
    model.log_share = np.log10(smooth / np.bincount(model.class_of, smooth, minlength=CLASSES)[model.class_of])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        model = shared.value
        for batch in batches:
            done = 0
            for texts in sequences_of(batch.column(0), vocabulary):
                part = batch.slice(done, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(window_scores(model, texts, vocabulary))], [*kept, "score"])
                done += len(texts)

    kept = ["row", "doc_id", "held_out", "n_tokens", "hot_known", "hot_sum"]
    scored = cut(every.select("ids", *kept).mapInArrow(
        score, f"row long, doc_id {kind(rows)}, held_out boolean, n_tokens long, hot_known long, hot_sum double, score double"))
    tails = every.select("row", F.explode("tail").alias("h"))
    tails = tails.join(words.select("h", "n"), "h").groupBy("row").agg(
        F.sum(F.log10(F.col("n") + 1)).alias("tail_sum"), F.count("n").alias("tail_known"))
    total = float(np.log10(totals["n"] + totals["v"] + 1))
    base = F.col("hot_sum") + F.coalesce("tail_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(total)
    return scored.join(tails, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("hot_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(totals["n"]).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
    )


def op5_lm_score(docs: DataFrame) -> DataFrame:
    return score_texts(docs.select("doc_id", "text"))

"""Secrets in texts, with a random forest that removes false findings."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.llm import text as T
from tablecraft.llm.columns import kind
from tablecraft.llm.storage import cut, most_frequent

#: Bytes of keys. Candidates are maximal runs of at least MIN_LENGTH of them with a digit, without letters or with a capital after a small
#: letter; runs of any content and length behind a known start; key headers; and values of any signs, of at least MIN_NAMED bytes, that a
#: naming word assigns with = or : (quoted ones up to the closing quote).
SIGNS = np.zeros(256, bool)
SIGNS[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_-.~"]] = True
MIN_LENGTH, MIN_NAMED, CONTEXT = 12, 4, 48
#: Starts of published key formats, and words that name a secret or something else that only looks like one.
STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk-", "sk_live_", "rk_live_", "AIza", "eyJ", "npm_", "hf_")
NAMING = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "credential", "auth", "bearer", "private", "passphrase")
OTHER = ("commit", "sha", "md5", "checksum", "hash", "uuid", "guid", "id", "version", "http", "https", "www", "example", "file", "page", "etag", "digest", "mail", "call", "tel")
#: Ordinary words for generated pass phrases and for values that are no secrets.
PLAIN = tuple(b"required optional value always never default string number none true false option first second people water place through "
              b"garden window river simple letter change between something table summer morning winter market answer several example".split())
#: Common words whose count shares say how word-like a candidate is; rounds of generated findings, of four each; size of a task's word sums.
DICTIONARY, PLANTED = 20_000, 2_000
HELD_BYTES = 40_000_000
FEATURES = ("length", "transition", "coverage", "entropy", "digit_share", "upper_share", "kind_changes", "known_start", "hex_only", "digits_only", "dots", "slashes",
            "dashes", "has_path", "has_at", "assigned", "quoted", "naming", "other", "distance", "signs", "blanks", "password")


@dataclass
class Language:
    """What ordinary words of the corpus look like."""

    transition: np.ndarray  # log probability of a byte class after another
    words: frozenset


_CODE = np.full(256, 38, np.int64)
_CODE[list(range(97, 123))] = np.arange(26)
_CODE[list(range(65, 91))] = np.arange(26)
_CODE[48:58] = 26 + np.arange(10)
_CODE[list(b"+/_=-.~")] = 36
_CODE[128:] = 37
N_CODES = 39


def learn_language(docs: DataFrame) -> Language:
    """Transition counts between characters and the most frequent words, over all texts. A task adds up every word that it reads and hands on
    its sums whenever they pass a fixed size, so the dictionary does not depend on how texts are dealt to tasks and slices."""

    def count(batches):
        pairs = np.zeros(N_CODES * N_CODES, np.int64)
        words: dict[bytes, int] = {}
        held = 0

        def sums():
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], ["w", "n"])

        for batch in batches:
            for _, _, w in T.word_slices(batch.column(0), T.PLAIN_WORDS, True):
                code = _CODE[w.data]
                if len(code) > 1:
                    pairs += np.bincount(code[:-1] * N_CODES + code[1:], minlength=N_CODES**2)
                long = np.flatnonzero(w.past - w.first > 2)
                _, first, n = np.unique(w.hashes()[long], return_index=True, return_counts=True)
                data = w.data.tobytes()
                for s, e, c in zip(w.first[long[first]].tolist(), w.past[long[first]].tolist(), n.tolist()):
                    b = data[s:e]
                    if b not in words:
                        held += e - s + 100
                    words[b] = words.get(b, 0) + c
                if held > HELD_BYTES:
                    yield sums()
                    words, held = {}, 0
        yield sums()
        keys = [b"\x00" + str(i).encode() for i in range(len(pairs))]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(pairs)], ["w", "n"])

    counts = cut(docs.select("text").mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")))
    is_pair = F.substring("w", 1, 1) == F.lit(bytearray(b"\x00"))
    got = counts.where(is_pair).union(most_frequent(counts.where(~is_pair), DICTIONARY, "w", ordered=True)).collect()  # both parts of fixed size
    table, words = np.ones((N_CODES, N_CODES)), set()
    for r in got:
        w = bytes(r["w"])
        if w[:1] == b"\x00":
            table.flat[int(w[1:])] += r["n"]
        else:
            words.add(w)
    return Language(np.log(table / table.sum(1, keepdims=True)), frozenset(words))


def coverage(value: bytes, words: frozenset) -> float:
    """Share of the letters that parts known as common words make up; parts end at signs, digits and changes to upper case."""
    parts = re.findall(rb"[A-Z]?[a-z]+|[A-Z]+", value)
    letters = sum(map(len, parts))
    return sum(len(p) for p in parts if p.lower() in words) / letters if letters else 0.0


def features(value: bytes, before: bytes, after: bytes, language: Language) -> list[float]:
    raw = np.frombuffer(value, np.uint8)
    n, code = len(raw), _CODE[np.frombuffer(value, np.uint8)]
    share = np.bincount(raw, minlength=256)[np.unique(raw)] / n
    kind = np.where(code < 26, np.where(raw < 97, 1, 0), np.where(code < 36, 2, 3))
    text = value.decode("ascii", "replace")
    near = re.findall(rb"[a-z_]+", before.lower())
    parts = [p for w in near for p in (w, *w.split(b"_"))]
    reach = next((i for i, w in enumerate(reversed(near)) if any(k.encode() in w for k in NAMING)), 9)
    tail = before.rstrip(b"\"'` \t")
    return [
        float(n), float(language.transition[code[:-1], code[1:]].mean()) if n > 1 else 0.0, coverage(value, language.words), float(-(share * np.log2(share)).sum()),
        float((kind == 2).mean()), float((kind == 1).mean()), float((kind[1:] != kind[:-1]).mean()) if n > 1 else 0.0, float(text.startswith(STARTS)),
        float(re.fullmatch(rb"[0-9a-fA-F]+", value) is not None), float(value.isdigit()), float(value.count(b".")), float(value.count(b"/")), float(value.count(b"-")),
        float(b"/" in value[1:-1] or b"\\" in before[-1:] or b"://" in before[-8:]), float(before[-1:] == b"@" or after[:1] == b"@"), float(tail[-1:] in (b"=", b":")),
        float(before[-1:] in (b'"', b"'", b"`")), float(any(k.encode() in w for w in near[-3:] for k in NAMING)),
        float(any(k.encode() in parts[-6:] for k in OTHER)), float(min(reach, 9)),
        float((~SIGNS[raw]).sum()), float(value.count(b" ")), float(any(k in w for w in near[-3:] for k in (b"pass", b"pwd", b"secret"))),
    ]


_NAMED = re.compile(rb"(?:" + "|".join(NAMING).encode() + rb")[a-z0-9_.-]{0,24}[\"'`\])]{0,2}[ \t]*$", re.I)
_LEAD = re.compile(rb"(?:>|=)?[ \t]*")
_VALUE = re.compile(rb"(?:[^\s\"'`&]|&(?![\w.-]*=))+")
_BEARER, _BARE = re.compile(rb"(?:earer|EARER)[ \t]+"), re.compile(rb"[^\s\"'`,;]+")
_HEADER = re.compile(rb"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----")


def named_values(raw: np.ndarray, at: np.ndarray):
    """(first, past) of values that a naming word assigns, of key headers and of bearer tokens; none crosses a row. A quoted value goes on to
    its closing quote in the line, whatever its length; any other ends at a blank, a quote or the next parameter."""
    text = raw.tobytes()
    signs = np.flatnonzero((raw == 61) | (raw == 58))
    owner = np.searchsorted(at, signs, side="right") - 1
    breaks = np.flatnonzero((raw == 10) | (raw == 13))
    quotes = {q: np.flatnonzero(raw == q) for q in b"\"'`"}

    def following(places: np.ndarray, i: int, high: int) -> int:
        k = int(np.searchsorted(places, i))
        return min(high, int(places[k])) if k < len(places) else high

    reach = 0
    for i, low, high in zip(signs.tolist(), at[owner].tolist(), at[owner + 1].tolist()):
        if not _NAMED.search(text[max(low, i - CONTEXT) : i]):
            continue
        s = _LEAD.match(text, i + 1, high).end()
        if s < high and text[s] in quotes:
            line = following(breaks, s, high)
            e = following(quotes[text[s]], s + 1, line)
            if s + 1 < e < line:
                if e - s - 1 >= MIN_NAMED:
                    yield s + 1, e
                continue
            s += 1  # never closed
        if s < reach:
            continue  # inside a value without quotes, which ends where this one would
        m = _VALUE.match(text, s, high)
        if m:
            reach = m.end()
            e = s + len(m[0].rstrip(b",;)]}>."))  # signs behind the value belong to the sentence
            if e - s >= MIN_NAMED:
                yield s, e
    for pattern in (_BEARER, _HEADER):
        for m in pattern.finditer(text):
            high = int(at[np.searchsorted(at, m.start(), side="right")])
            v = m if pattern is _HEADER else _BARE.match(text, m.end(), high) if m.end() < high else None
            if v and v.end() <= high and v.end() - v.start() >= MIN_NAMED:
                yield v.span()


def with_start(raw: np.ndarray, w: T.Words) -> np.ndarray:
    """Numbers of the runs that go on behind a known start."""
    found = []
    for start in (s.encode() for s in STARTS):
        at = np.flatnonzero(w.past - w.first > len(start))
        for k, byte in enumerate(start):
            at = at[raw[w.first[at] + k] == byte]
        found.append(at)
    return np.concatenate(found)


def candidates_of(texts: pa.Array):
    """(row, first byte, past byte, value, before, after) of every candidate in whole texts. A run inside a named value is part of it."""
    data, ends = T.column_bytes(texts)
    for i, j in T.slices(ends):
        raw, at = data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        w = T.split_words(raw, at, SIGNS, False)
        long = np.flatnonzero(w.past - w.first >= MIN_LENGTH)
        digits = np.r_[0, np.cumsum((raw >= 48) & (raw < 58))]
        letters = np.r_[0, np.cumsum((_CODE[raw] < 26))]
        small, capital = (raw >= 97) & (raw < 123), (raw >= 65) & (raw < 91)
        turns = np.r_[0, 0, np.cumsum(small[:-1] & capital[1:])] if len(raw) else np.zeros(2, np.int64)
        counted = lambda c: c[w.past[long]] - c[w.first[long]] > 0
        turned = turns[w.past[long]] - turns[w.first[long] + 1] > 0
        kept = np.unique(np.concatenate([long[counted(digits) | ~counted(letters) | turned], with_start(raw, w)]))
        spans = sorted({*zip(w.first[kept].tolist(), w.past[kept].tolist()), *named_values(raw, at)}, key=lambda x: (x[0], -x[1]))
        reach = 0
        for s, e in spans:
            if e <= reach:
                continue
            reach = e
            d = int(np.searchsorted(at, s, side="right")) - 1
            yield i + d, s - int(at[d]), e - int(at[d]), raw[s:e].tobytes(), raw[max(int(at[d]), s - CONTEXT) : s].tobytes(), raw[e : min(int(at[d + 1]), e + 8)].tobytes()


def planted_findings(n: int, seed: int = 3) -> list[tuple[bytes, bytes, bytes, int]]:
    """Labelled findings: values of public key formats and look-alikes in both kinds of surroundings (value, before, after, label)."""
    rng = np.random.default_rng(seed)
    abc = b"abcdefghijklmnopqrstuvwxyz"
    sets = {"hex": b"0123456789abcdef", "b64": abc.upper() + abc + b"0123456789+/", "word": abc.upper() + abc + b"0123456789", "upper": abc.upper() + b"0123456789", "dec": b"0123456789", "letters": abc.upper() + abc, "signed": abc.upper() + abc + b"0123456789!@#$%^*?!@#$%^*?"}
    draw = lambda kind, k: bytes(rng.choice(np.frombuffer(sets[kind], np.uint8), k))
    pick = lambda options: options[int(rng.integers(len(options)))]
    word = lambda: draw("word", int(rng.integers(3, 9))).lower()
    out = []
    for _ in range(n):
        value = pick([lambda: draw("hex", pick([32, 40, 64])), lambda: b"AKIA" + draw("upper", 16), lambda: b"ghp_" + draw("word", 36), lambda: draw("b64", 40), lambda: b"sk-" + draw("word", 32),
                      lambda: b"eyJ" + draw("word", 20) + b"." + draw("word", 40), lambda: draw("word", int(rng.integers(14, 30))),
                      lambda: draw("letters", int(rng.integers(12, 40)))])()
        name = pick([b"token", b"api_key", b"secret", b"password", b"auth_token", b"private_key", b"SECRET_KEY", b"apikey", b"Bearer"])
        mark = pick([b' = "', b'="', b": ", b" = '", b": \"", b"=", b" "])
        out.append((value, word() + b" " + word() + b" " + name + mark, pick([b'"', b"'", b" ", b"\n"]), 1))
        short = pick([b"password", b"passwd", b"pwd", b"db_password", b"secret", b"DB_PASS_SECRET"])
        choice = int(rng.integers(8))
        if choice < 4:
            out.append((draw("signed", int(rng.integers(8, 20))), word() + b" " + short + pick([b"=", b": ", b" = "]), b"\n", 1))
        elif choice < 6:
            out.append((b" ".join(pick(PLAIN) for _ in range(int(rng.integers(3, 6)))), word() + b" " + pick([b"passphrase", short]) + pick([b'="', b' = "', b': "']), b'"', 1))
        else:
            out.append((b"-----BEGIN " + pick([b"RSA ", b"EC ", b"OPENSSH ", b""]) + b"PRIVATE KEY-----", pick([b"", word() + b" ", word() + b"\n"]), b"\n", 1))
        named = pick([b"key", b"token", b"auth", b"the password", b"secret", b"authority", b"keyword"]) + pick([b": ", b"=", b" = ", b": "])
        out.append((pick([lambda: pick(PLAIN), lambda: pick(PLAIN) + b"_" + pick(PLAIN), lambda: pick(PLAIN) + b"()", lambda: pick(PLAIN) + b"." + pick(PLAIN), lambda: pick(PLAIN).title() + pick(PLAIN).title() + pick(PLAIN).title()])(),
                    word() + b" " + named, pick([b" ", b"\n"]), 0))
        look = pick([lambda: draw("hex", 8) + b"-" + b"-".join(draw("hex", 4) for _ in range(3)) + b"-" + draw("hex", 12), lambda: draw("hex", pick([32, 40, 64])), lambda: draw("dec", pick([12, 13, 16])),
                     lambda: b"mail" + draw("dec", 1) + b".example.com", lambda: word() + b"/" + word() + b"/" + word() + draw("dec", 2) + b".html", lambda: b"v" + draw("dec", 1) + b"." + draw("dec", 2) + b".0-rc" + draw("dec", 4),
                     lambda: word() + b"_" + word() + b"_" + draw("dec", 4), lambda: b"20" + draw("dec", 2) + b"-0" + draw("dec", 1) + b"-1" + draw("dec", 1) + b"T10"])()
        near = pick([b"commit ", b"checksum: ", b"sha256 ", b"uuid=", b"id: ", b"see ", b"call ", b"version ", b"http://www.", b"", b"page ", b"the ", b"file "])
        out.append((look, word() + b" " + word() + b" " + near, pick([b" ", b".", b",", b"\n"]), 0))
    return out


def feature_rows(docs: DataFrame, language: Language) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(language)  # DICTIONARY words and a fixed table

    def work(batches):
        for batch in batches:
            got = list(candidates_of(batch.column(2)))
            at = pa.array([g[0] for g in got], pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(at), batch.column(1).take(at), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] - g[1] for g in got], pa.int64()),
                pa.array([features(*g[3:], shared.value) for g in got], pa.list_(pa.float64())),
            ], ["doc_id", "row", "start", "length", "features"])

    return docs.select("doc_id", "row", "text").mapInArrow(work, f"doc_id {kind(docs)}, row long, start long, length long, features array<double>")


def train_forest(spark, language: Language, planted: int = PLANTED, seed: int = 3, trees: int = 40) -> RandomForestClassificationModel:
    rows = [(features(v, b, a, language), float(y)) for v, b, a, y in planted_findings(planted, seed)]
    frame = spark.createDataFrame(rows, "features array<double>, label double").select(array_to_vector("features").alias("features"), "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=8, seed=11).fit(frame)


def scan_secrets(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_candidates, n_findings and findings (start byte, length, probability) of each row of `docs` (doc_id, text, ...).

    Every run of key characters with a digit, a mix of small and capital letters or a known start is a candidate, and so is every value that
    a naming word assigns, whatever its signs. A random forest judges it by its length,
    character transitions and common words of this corpus, path marks and the words before it. Character and word statistics cover all
    texts; the forest learns from generated labelled findings of public formats and look-alikes, a fixed number.

    Missing and empty texts have no candidates. Repeated rows get equal results each, since rows are numbered; columns of `docs` other
    than doc_id and text are not needed and not returned.
    """
    rows = docs.select("doc_id", "text").withColumn("row", F.xxhash64(F.lit(5), "doc_id", "text"))
    language = learn_language(rows)
    forest = train_forest(docs.sparkSession, language)
    found = feature_rows(rows, language).withColumn("features", array_to_vector("features"))
    judged = forest.transform(found).select("row", "start", "length", vector_to_array("probability")[1].alias("probability")).distinct()
    real = F.when(F.col("probability") >= threshold, F.struct("start", "length", "probability"))
    per_row = judged.groupBy("row").agg(F.count("*").alias("n_candidates"), F.sort_array(F.collect_list(real)).alias("findings"))
    out = rows.select("doc_id", "row").join(per_row, "row", "left")
    empty = F.array().cast("array<struct<start:bigint,length:bigint,probability:double>>")
    return out.select("doc_id", F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"),
                      F.coalesce(F.size(F.col("findings")), F.lit(0)).cast("long").alias("n_findings"), F.coalesce("findings", empty).alias("findings"))


def op10_secret_scan(docs: DataFrame) -> DataFrame:
    return scan_secrets(docs)

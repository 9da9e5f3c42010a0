"""Packing token sequences into as few windows as possible.

Documents are tokenised, ended by END_ID, and only longer ones are cut. What matters for packing is how many pieces of
each length there are, a histogram of at most `size` numbers, so the configuration linear program over it is solved on
the driver: multiplicative weights fall on lengths as they are covered, and a knapsack dynamic program prices the best
configurations for the weights. The fractional solution is rounded down and what is left goes by best fit over the same
histogram. A configuration says which lengths share a sequence; the k-th piece of a length finds its sequence and
offset from k alone, so the pieces are placed where they are and never meet in one task.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, cut, empty_text

SIZE = 1024
END_ID = 2
#: Multiplicative weights: rounds at most, the share of a length that one configuration may cover in a round, the rate of
#: the weights and how far ahead of the others a length can count, how much less than the best a configuration may weigh.
ROUNDS, STEP, RATE, AHEAD, SLACK = 300, 0.8, 0.0005, 3.0, 0.001
#: How much a full-sized length counts as ahead of the others: long pieces go first while short ones are there to fill gaps.
LONG = 2.0
#: The share of all tokens below which best fit ends the fractional solution, by which part of a piece, and the share of a
#: length below which it takes no part in a round.
REST, GRAIN, CLOSED = 0.02, 1024, 0.001
#: Shares of the fractional solution that are tried; what a share leaves goes by best fit.
SHARES = (1.0, 0.9, 0.75, 0.5, 0.25, 0.1, 0.0)
#: The word split of byte-level BPE (a fixed value of these tokenizers).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the files of byte-level tokenizers: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes, by the vocabulary of a tokenizers file.

    For a plain byte-level BPE whose ids follow its merges (checked here), the merges run in tiktoken, which gives the
    same ids about four times as fast; any other file is left to tokenizers. A special token that stands in a text gets
    its own id, as tokenizers gives it.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.ranks = self.plain_ranks(spec)
        if self.ranks:
            import tiktoken

            special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
            self.engine = tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=self.ranks, special_tokens=special)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.engine = Tokenizer.from_file(path)

    @staticmethod
    def plain_ranks(spec: dict) -> dict[bytes, int]:
        """Bytes to id if ids are ranks, else nothing."""
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if model.get("type") != "BPE" or spec.get("normalizer") or any(split.get(k, v) != v for k, v in plain.items()) or split.get("type") != "ByteLevel":
            return {}
        if any(t.get(k) for t in spec.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip")):
            return {}
        if model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            return {}
        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        first = min((vocab[a + b] for a, b in merges), default=0)
        if any(vocab[a + b] != first + i for i, (a, b) in enumerate(merges)):
            return {}
        letters, special = byte_letters(), {t["content"] for t in spec.get("added_tokens", ())}
        return {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}

    def encode(self, text: str) -> bytes:
        if self.ranks:
            return self.engine.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        return np.array(self.engine.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every document cut into pieces of at most size tokens, the first the shorter one.

    Returns doc_id, piece, start, length, ids_crc32, and task and nth: the piece is the nth of its length in its task.
    with_ids adds the ids. A null text counts as empty: one piece with the end id.
    """
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(path).encode, TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in chunks(batches):
            rows, out = [], []
            for i, text in enumerate(empty_text(batch.column(1).to_pylist())):
                ids = encode(text) + end if text else end
                n = len(ids) // 4
                cuts = [0, *range(n % size or size, n + 1, size)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    part = ids[4 * a : 4 * b]
                    rows.append((i, k, a, b - a, zlib.crc32(part), task, seen[b - a]))
                    seen[b - a] += 1
                    if with_ids:
                        out.append(np.frombuffer(part, "<u4").astype(np.int32))
            table = np.array(rows, np.int64).reshape(-1, 7)
            columns = [batch.column(0).take(pa.array(table[:, 0])), *[pa.array(table[:, j].copy()) for j in range(1, 7)]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
            if with_ids:
                columns, names = [*columns, pa.array(out, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(kernel, f"doc_id {kind}, piece long, start long, length long, ids_crc32 long, task long, nth long" + ", ids array<int>" * with_ids).withColumn("piece", F.col("piece").cast("int"))


def knapsack(value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room up to size the most value that fits into it, and the length to take first for that (0: leave one
    place empty): an unbounded knapsack by dynamic programming.

    value[l - 1] is the value of a piece of length l, -inf where there is none.
    """
    best, first = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    for c in range(1, size + 1):
        gains = value[:c] + best[c - 1 :: -1]
        k = c - 1 - int(gains[::-1].argmax())  # of equal gains the longest piece: short ones are needed to fill gaps
        best[c], first[c] = (gains[k], k + 1) if gains[k] > best[c - 1] else (best[c - 1], 0)
    return best, first


def traced(first: np.ndarray, room: int) -> dict[int, int]:
    """The lengths, with how often each, that knapsack() put into room."""
    chosen: dict[int, int] = {}
    while room:
        if l := int(first[room]):
            chosen[l] = chosen.get(l, 0) + 1
        room -= l or 1
    return chosen


def best_configuration(value: np.ndarray, size: int) -> dict[int, int]:
    """The lengths, with how often each, of the most valuable sequence."""
    return traced(knapsack(value, size)[1], size)


def fractional(counts: np.ndarray, size: int, rounds: int = ROUNDS) -> dict[tuple, float]:
    """Configurations, as ((length, times), ...), and how often each is used, covering counts with nearly the least total.

    A token of a length weighs exp(RATE * how much more of this length is open than of all tokens), a factor that falls
    with all that is covered, and slightly more the longer the piece. Each round one knapsack prices for every open length the best configuration that holds it;
    those within SLACK of the best are used until STEP of what is open of one of their lengths is covered. So what is
    open shrinks by factors, and the number of rounds depends on the number of lengths and not on their counts. The last
    REST of the tokens go by best fit in GRAIN-ths of a piece.
    """
    lengths, total = np.arange(1, size + 1), counts.astype(float)
    left, tokens, used = total.copy(), float((total * np.arange(1, size + 1)).sum()), {}
    for _ in range(rounds):
        part = float((left * lengths).sum()) / max(tokens, 1.0)
        if part < REST:
            break
        open_ = left > CLOSED * part * total
        ahead = np.minimum(left / np.maximum(total, 1) / part, AHEAD) - 1
        value = np.where(open_, lengths * np.exp(RATE * (ahead + LONG * lengths / size)), -np.inf)
        best, first = knapsack(value, size)
        for l in (np.flatnonzero(open_)[::-1] + 1).tolist():
            if value[l - 1] + best[size - l] < best[size] * (1 - SLACK):
                continue
            chosen = traced(first, size - l)
            chosen[l] = chosen.get(l, 0) + 1
            chosen = {k: min(a, int(counts[k - 1])) for k, a in chosen.items()}
            times = min(STEP * left[k - 1] / a for k, a in chosen.items())
            key = tuple(sorted(chosen.items(), reverse=True))
            used[key] = used.get(key, 0.0) + times
            for k, a in chosen.items():
                left[k - 1] -= a * times
    for config, n in best_fit(np.ceil(np.maximum(left, 0) * GRAIN).astype(np.int64), size).items():
        key = tuple(sorted(config, reverse=True))
        used[key] = used.get(key, 0.0) + n / GRAIN
    return used


def best_fit(counts: np.ndarray, size: int) -> dict[tuple, int]:
    """Best fit over a histogram, longest first; sequences alike are handled together."""
    open_: dict[tuple[int, tuple], int] = {}
    for l in range(size, 0, -1):
        left = int(counts[l - 1])
        for room, items in sorted(k for k in open_ if k[0] >= l):
            if not left:
                break
            bins, each = open_.pop((room, items)), room // l
            full = min(bins, left // each)
            odd = left - full * each if full < bins and left - full * each < each else 0
            for n, a in ((full, each), (1 if odd else 0, odd), (bins - full - (1 if odd else 0), 0)):
                if n:
                    key = (room - a * l, (*items, (l, a)) if a else items)
                    open_[key] = open_.get(key, 0) + n
                    left -= n * a
        each = size // l
        for n, a in ((left // each, each), (1 if left % each else 0, left % each)):
            if n:
                key = (size - a * l, ((l, a),))
                open_[key] = open_.get(key, 0) + n
    return {items: n for (_, items), n in sorted(open_.items())}


def rounded_down(solution: dict[tuple, float], counts: np.ndarray, size: int, share: float) -> dict[tuple, int]:
    """share of the configurations that fill a sequence, rounded down and within counts; the rest by best fit."""
    left = counts.copy()
    done: dict[tuple, int] = {}
    for config, x in solution.items():
        if sum(l * a for l, a in config) == size:  # gaps are better left to best fit
            n = min([int(share * x), *(int(left[l - 1]) // a for l, a in config)])
            if n:
                done[config] = n
                for l, a in config:
                    left[l - 1] -= a * n
    for config, n in best_fit(left, size).items():
        done[config] = done.get(config, 0) + n
    return done


def plan(counts: np.ndarray, size: int = SIZE) -> dict[tuple, int]:
    """How often to use each configuration so that exactly counts[l - 1] pieces of each length l are placed.

    Of the rounded solutions the one with the fewest sequences; ties go to the larger share of the fractional solution.
    """
    left = counts.astype(np.int64).copy()
    whole = {((size, 1),): int(left[size - 1])} if left[size - 1] else {}
    left[size - 1] = 0
    if not left.any():
        return whole
    solution = fractional(left, size)
    return whole | min((rounded_down(solution, left, size, s) for s in SHARES), key=lambda d: sum(d.values()))


def places(configurations: dict[tuple, int], size: int = SIZE) -> dict[int, np.ndarray]:
    """For each length the columns first rank, times in a sequence, first sequence, offset, in order of rank."""
    rows: dict[int, list] = {}
    ranks = np.zeros(size + 1, np.int64)
    sequence = 0
    for config, n in configurations.items():
        offset = 0
        for l, a in config:
            rows.setdefault(l, []).append((ranks[l], a, sequence, offset))
            ranks[l] += a * n
            offset += a * l
        sequence += n
    return {l: np.array(x, np.int64) for l, x in rows.items()}


def assign(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """parts with sequence_id and offset. parts must be kept somewhere: its task and nth columns are read twice."""
    per_task = parts.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(size, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most size rows
        histogram[row.length - 1] = row.n
    found = places(plan(histogram, size), size)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = per_task.select("task", "length", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = parts.join(bases, ["task", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    kept = [c for c in parts.columns if c not in ("task", "nth")]
    at = {c: i for i, c in enumerate([*kept, "rank"])}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(at["length"]).to_numpy(), batch.column(at["rank"]).to_numpy()
            sequence, offset = np.zeros((2, length.size), np.int64)
            for l in np.unique(length).tolist():
                own = np.flatnonzero(length == l)
                table = found[l]
                first, times, base, start = table[np.searchsorted(table[:, 0], rank[own], side="right") - 1].T
                behind = rank[own] - first
                sequence[own], offset[own] = base + behind // times, start + behind % times * l
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    ranked = ranked.select(*kept, "rank")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema[:-1])
    return ranked.mapInArrow(kernel, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Where every piece of every document goes: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the end id; longer documents than size are cut, whole otherwise. Repeated rows
    and rows without doc_id are packed like any other; columns other than doc_id and text are not looked at. An empty
    table gives an empty result.
    """
    return assign(cut(pieces(docs, tokenizer, size, end_id)), size)


def sequences(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids, at most size of them."""
    placed = assign(cut(pieces(docs, tokenizer, size, end_id, with_ids=True)), size)
    grouped = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # at most size ids
    return grouped.select("sequence_id", F.flatten("parts.ids").alias("ids"))

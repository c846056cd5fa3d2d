"""Operator 12: SentencePiece encoding and decoding by vectorised merge rounds.

The texts of a batch are one flat array of symbols. Two neighbours that stand side by side in no piece can't meet in a
merge, so the array is cut there: into words, as no piece goes on past a word's end, and also inside words. In each round

1.  the least rank of a pair is taken in each word (a segmented minimum),
2.  all pairs of that rank merge at once, overlapping ones from the left,
3.  the array is compacted, and words without a pair that could merge are finished.

The library merges one pair at a time: the one of best score, the first of equals. Merging all pairs of a rank at once
is the same as long as no merge makes a pair that would come before the next of them; a word's merges therefore end
with the first one that makes such a pair, and the next round goes on from there. Characters that are no piece
become the pieces of their UTF-8 bytes.

The model file is a parameter; nothing is trained. Models other than those of the kind handled (BPE with byte fallback,
identity normalisation, a space put before the text, only normal, byte, control and unknown pieces) raise an error.

Rows never move: encoding and decoding run inside Arrow batches, in slices of SLICE symbols cut at word ends, so a task
holds one batch and one slice. The number of rounds is that of distinct merges of the longest word; a text of a
million characters that can nowhere be cut takes thousands of rounds over its own symbols.

Defined results: null text is empty, and empty text has no ids; bytes that are not UTF-8 count as U+FFFD; repeated rows give repeated
results; an empty table gives an empty result; only the id and the text are read, other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

SLICE = 200_000
SPACE = "▁"
NONE = np.int32(2**31 - 1)
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class Model(NamedTuple):
    symbol_of: np.ndarray  # code point -> symbol; 0 where no piece has the character
    next_to: tuple[np.ndarray, np.ndarray]  # [symbol, side] -> its number on that side, [number, number]: side by side in a piece
    run: tuple[int, int]  # a symbol whose long runs are cut, and after how many
    keys: np.ndarray  # hashed table of pairs: (left << 32 | right) + 1, 0 where free
    merged: np.ndarray  # the pair's piece
    rank: np.ndarray  # of each symbol: 0 is the best score, equal scores have equal ranks
    better: np.ndarray  # of each symbol: the least rank of a piece made of it and a neighbour
    n_pieces: int  # symbols from here on are characters that are no pieces themselves
    byte_ids: np.ndarray
    kind: np.ndarray
    text: tuple[np.ndarray, np.ndarray]  # bytes of all pieces with spaces, offsets
    unknown: bytes


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _table(pairs: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Open addressing at a load of a quarter or less."""
    bits = max(4, (4 * len(pairs)).bit_length())
    keys, merged = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int32)
    given = np.fromiter(pairs.keys(), np.int64, len(pairs)) + 1
    pieces = np.fromiter(pairs.values(), np.int32, len(pairs))
    at = _slot(given, bits)
    left = np.arange(len(given))
    while len(left):
        here, first = np.unique(at[left], return_index=True)
        free = keys[here] == 0
        put = left[first[free]]
        keys[at[put]], merged[at[put]] = given[put], pieces[put]
        left = left[keys[at[left]] != given[left]]
        at[left] = (at[left] + 1) & ((1 << bits) - 1)
    return keys, merged


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    rules, trainer = m.normalizer_spec, m.trainer_spec
    kind = np.array([p.type for p in m.pieces])
    fits = trainer.model_type == trainer.BPE and trainer.byte_fallback and not trainer.treat_whitespace_as_suffix
    fits = fits and rules.add_dummy_prefix and rules.escape_whitespaces and not (rules.remove_extra_whitespaces or rules.precompiled_charsmap or m.denormalizer_spec.precompiled_charsmap)
    if not fits or not np.isin(kind, (NORMAL, UNKNOWN, CONTROL, BYTE)).all():
        raise ValueError("only BPE models with byte fallback and identity normalisation are handled")
    pieces = [p.piece for p in m.pieces]
    ids = {p: k for k, p in enumerate(pieces) if kind[k] == NORMAL}
    n = len(pieces)
    # Symbol 0 stands for characters that no piece has; the unknown piece has its place, which no text gives.
    single: dict[str, int] = {}
    for p in ids:
        for c in p:
            single.setdefault(c, ids.get(c, n + len(single)))
    symbol_of = np.zeros(max(map(ord, single), default=0) + 2, np.int32)
    symbol_of[[ord(c) for c in single]] = list(single.values())
    size = max(n, max(single.values(), default=0) + 1)
    scores = np.array([-np.float32(m.pieces[k].score) for k in ids.values()])
    rank = np.full(size, NONE, np.int32)
    rank[list(ids.values())] = np.unique(scores, return_inverse=True)[1]
    next_to = set()
    pairs: dict[int, int] = {}
    better = np.full(size, NONE, np.int32)
    symbols = single | ids
    for p, k in ids.items():
        for cut in range(1, len(p)):
            next_to.add((single[p[cut - 1]], single[p[cut]]))
            a, b = symbols.get(p[:cut]), symbols.get(p[cut:])
            if a is not None and b is not None:
                pairs[(a << 32) | b] = k
                for part in (a, b):
                    better[part] = min(better[part], rank[k])
    # Bigrams as a matrix over the characters that take part, numbered in turn.
    touching = np.zeros((size, 2), np.int32)
    firsts, seconds = ({s: j + 1 for j, s in enumerate(sorted({x[side] for x in next_to}))} for side in (0, 1))
    for side, numbers in enumerate((firsts, seconds)):
        touching[list(numbers), side] = list(numbers.values())
    matrix = np.zeros((len(firsts) + 1, len(seconds) + 1), bool)
    for a, b in next_to:
        matrix[firsts[a], seconds[b]] = True
    keys, merged = _table(pairs)
    byte_ids = np.zeros(256, np.int32)
    for k in np.flatnonzero(kind == BYTE):
        byte_ids[int(pieces[k][3:5], 16)] = k
    blobs = [p.replace(SPACE, " ").encode() if t == NORMAL else b"" if t == CONTROL else bytes([int(p[3:5], 16)]) if t == BYTE else trainer.unk_surface.encode() for p, t in zip(pieces, kind, strict=True)]
    text = np.frombuffer(b"".join(blobs), np.uint8), np.append(0, np.cumsum([len(b) for b in blobs]))
    return Model(symbol_of, (touching, matrix), _run(ids, rank), keys, merged, rank, better, n, byte_ids, kind, text, trainer.unk_surface.encode())


def _run(ids: dict[str, int], rank: np.ndarray) -> tuple[int, int]:
    """(symbol of the space mark, length of its longest run) if long runs fall into such blocks from the left in any case, else (0, 1).

    That is so if pieces of marks have one rank that is worse than all others, and no other piece has a mark but at its
    beginning: then all other merges come first, take the last mark at most, and what is left merges from the left; and if,
    on the way to the longest run, no mark beyond it is merged.
    """
    runs = {len(p): rank[k] for p, k in ids.items() if len(p) > 1 and set(p) == {SPACE}}
    others = [p for p in ids if set(p) != {SPACE}]
    if SPACE not in ids or len(set(runs.values())) != 1 or any(SPACE in p[1:] for p in others) or max(runs.values()) <= max(rank[ids[p]] for p in others):
        return 0, 1
    longest = max(runs)
    marks = [1] * 2 * longest
    while marks[0] < longest:
        at = next((k for k in range(len(marks) - 1) if marks[k] + marks[k + 1] in runs), None)
        if at is None:
            return 0, 1
        marks[at : at + 2] = [marks[at] + marks[at + 1]]
    return (ids[SPACE], longest) if marks[1:] == [1] * longest else (0, 1)


def _pair(model: Model, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The piece that each pair makes, or -1."""
    keys = (left.astype(np.int64) << 32 | right) + 1
    bits = len(model.keys).bit_length() - 1
    at = _slot(keys, bits)
    found = model.keys[at]
    out = np.where(found == keys, model.merged[at], np.int32(-1))
    again = np.flatnonzero((found != keys) & (found != 0))
    while len(again):
        at[again] = (at[again] + 1) & ((1 << bits) - 1)
        found = model.keys[at[again]]
        hit = found == keys[again]
        out[again[hit]] = model.merged[at[again[hit]]]
        again = again[~hit & (found != 0)]
    return out


def _merge(model: Model, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of words that begin at starts. (merged symbols, the place of each among the symbols given)."""
    place = np.arange(len(symbols), dtype=np.int32)
    word = np.zeros(len(symbols), np.int32)
    word[starts[1:]] = 1
    word = np.cumsum(word, dtype=np.int32)
    # The piece that each symbol makes with the next one of its word, and its rank.
    makes = np.full(len(symbols), -1, np.int32)
    inside = np.flatnonzero(word[1:] == word[:-1])
    makes[inside] = _pair(model, symbols[inside], symbols[inside + 1])
    rank = np.where(makes >= 0, model.rank[makes], NONE)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        least = np.minimum.reduceat(rank, heads)
        sizes = np.diff(np.append(heads, len(symbols)))
        of_word = np.repeat(least, sizes)
        going = of_word < NONE
        if not going.all():
            done.append((place[~going], symbols[~going]))
            rest = np.flatnonzero(going)
            place, symbols, word, makes, rank, of_word = (x.take(rest) for x in (place, symbols, word, makes, rank, of_word))
            if not len(symbols):
                break
        hits = np.flatnonzero(rank == of_word)
        # Overlapping pairs: every second one of a run, from the left.
        head = np.append(True, np.diff(hits) > 1)
        offset = np.arange(len(hits)) - np.maximum.accumulate(np.where(head, np.arange(len(hits)), 0))
        hits = hits[offset % 2 == 0]
        new, ranks = makes[hits], rank[hits]
        hits, new = _up_to_better(model, symbols, word, hits, new, ranks)
        # Merge and compact.
        symbols[hits] = new
        keep = np.ones(len(symbols), bool)
        keep[hits + 1] = False
        keep = np.flatnonzero(keep)
        changed = np.zeros(len(symbols), bool)
        changed[hits] = True
        place, symbols, word, makes, rank, changed = (x.take(keep) for x in (place, symbols, word, makes, rank, changed))
        # Pairs with a merged symbol on either side are looked up again.
        changed[:-1] |= changed[1:]
        at = np.flatnonzero(changed)
        makes[at] = -1
        at = at[at + 1 < len(symbols)]
        at = at[word[at] == word[at + 1]]
        makes[at] = _pair(model, symbols[at], symbols[at + 1])
        changed = np.flatnonzero(changed)
        rank[changed] = np.where(makes[changed] >= 0, model.rank[makes[changed]], NONE)
    if not done:
        return symbols, place
    places, merged = (np.concatenate(x) for x in zip(*done, strict=True))
    by = np.argsort(places, kind="stable")
    return merged[by], places[by]


def _up_to_better(model: Model, symbols: np.ndarray, word: np.ndarray, hits: np.ndarray, new: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The merges of each word up to the first that makes a pair of the same or a better rank, which would come next."""
    maybe = np.flatnonzero(model.better[new] <= ranks)
    if not len(maybe):
        return hits, new
    at, here = hits[maybe], new[maybe]
    before = symbols[at - 1]  # of the first symbol: any, it is left out below
    follows = np.append(False, np.diff(hits) == 2)[maybe]  # the symbol before has just been merged
    before = np.where(follows, new[maybe - 1], before)
    has_before = (at > 0) & (word[at - 1] == word[at])
    after = np.minimum(at + 2, len(symbols) - 1)
    has_after = (at + 2 < len(symbols)) & (word[after] == word[at])
    left, right = (np.where(ok, _pair(model, a, b), -1) for ok, a, b in ((has_before, before, here), (has_after, here, symbols[after])))
    best = np.minimum(np.where(left >= 0, model.rank[left], NONE), np.where(right >= 0, model.rank[right], NONE))
    stops = np.zeros(len(hits), bool)
    stops[maybe[best <= ranks[maybe]]] = True
    if not stops.any():
        return hits, new
    words = word[hits]
    head = np.append(True, words[1:] != words[:-1])
    earlier = np.cumsum(stops) - stops  # stops before this merge, of all words
    keep = earlier == np.repeat(earlier[head], np.diff(np.append(np.flatnonzero(head), len(hits))))
    return hits[keep], new[keep]


def encode_texts(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after the other, offsets of each text's and the end)."""
    model = load(path)
    whole = "".join(f"{SPACE}{t}" if t else "" for t in texts)
    lengths = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    ends = np.cumsum(lengths)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes == 32, np.uint32(ord(SPACE)), codes)
    symbols = model.symbol_of[np.minimum(codes, len(model.symbol_of) - 1)]
    touching, matrix = model.next_to
    apart = np.ones(len(symbols), bool)
    if len(symbols):
        apart[1:] = ~matrix[touching[symbols[:-1], 0], touching[symbols[1:], 1]]
        apart[ends[(ends > 0) & (ends < len(symbols))]] = True
    mark, longest = model.run
    if mark:
        is_mark = symbols == mark
        at = np.arange(len(symbols))
        begun = np.maximum.accumulate(np.where(is_mark & ~apart, 0, at))
        apart |= is_mark & ((at - begun) % longest == 0)
    starts = np.flatnonzero(apart)
    ids, counts = [], np.zeros(len(texts), np.int64)
    begin = 0
    while begin < len(symbols):
        # Up to the last word end within SLICE, or that of a longer word.
        k = np.searchsorted(starts, begin + SLICE, "right") - 1
        end = starts[k] if len(symbols) > begin + SLICE and starts[k] > begin else (starts[k + 1] if k + 1 < len(starts) and len(symbols) > begin + SLICE else len(symbols))
        some = starts[np.searchsorted(starts, begin) : np.searchsorted(starts, end)] - begin
        merged, place = _merge(model, symbols[begin:end].copy(), some)
        place = place.astype(np.int64) + begin
        plain = (merged > 0) & (merged < model.n_pieces)
        sizes = np.ones(len(merged), np.int64)
        if not plain.all():
            # Characters that are no pieces: their bytes.
            chars, which = np.unique(codes[place[~plain]], return_inverse=True)
            coded = [chr(c).encode("utf-8", "surrogatepass") for c in chars]
            sizes[~plain] = np.array([len(c) for c in coded])[which]
            out = np.repeat(np.where(plain, merged, 0), sizes)
            at = np.repeat(~plain, sizes)
            table = np.frombuffer(b"".join(coded), np.uint8)
            offsets = np.append(0, np.cumsum([len(c) for c in coded]))
            out[at] = model.byte_ids[_spread(table, offsets[which], offsets[which + 1] - offsets[which])]
            merged = out
        ids.append(merged)
        counts += np.bincount(np.searchsorted(ends, place, "right"), weights=sizes, minlength=len(texts)).astype(np.int64)
        begin = end
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    return flat.astype(np.int32), np.append(0, np.cumsum(counts))


def _spread(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """data[start : start + length] of each, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


_RUNS = re.compile(r"�+")


def decode_ids(ids: np.ndarray, path: str) -> str:
    """The text of ids: pieces joined, spaces for their marks but one at the beginning; each byte that is no part of UTF-8 is U+FFFD."""
    model = load(path)
    if len(ids) and (ids.min() < 0 or ids.max() >= model.n_pieces):
        raise ValueError("an id is not of this model")
    data, offsets = model.text
    kind = model.kind[ids]
    seen = np.flatnonzero(kind != CONTROL)
    raw = _spread(data, offsets[ids], offsets[ids + 1] - offsets[ids])
    plain = len(seen) and kind[seen[0]] == NORMAL and raw[:1].tobytes() == b" "
    if not (kind == BYTE).any():
        return raw[1 if plain else 0 :].tobytes().decode()
    # Runs of byte pieces stand alone: what they lack, the piece after them doesn't complete.
    is_byte = (kind == BYTE).astype(np.int8)
    cuts = np.flatnonzero(np.diff(is_byte)) + 1
    if plain and is_byte[0] == 0 and not len(cuts):
        return raw[1:].tobytes().decode()
    parts, ends = [], np.cumsum(offsets[ids + 1] - offsets[ids])
    low = 0
    for cut in [*cuts, len(ids)]:
        high = int(ends[cut - 1])
        part = raw[low:high].tobytes()
        parts.append(_bytes_text(part) if is_byte[cut - 1] else part.decode())
        low = high
    out = "".join(parts)
    return out[1:] if plain else out


def _bytes_text(data: bytes) -> str:
    """Valid characters, and U+FFFD for each byte of the rest."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def _mapped(rows: DataFrame, work: Callable[[pa.RecordBatch], list[pa.Array]], schema: str) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A batch's text may be long: some rows at a time.
            size = max(1, len(batch) * 4_000_000 // max(batch.nbytes, 1))
            for k in range(0, len(batch), size):
                part = batch.slice(k, size)
                yield pa.RecordBatch.from_arrays([part.column(0), *work(part)], names)

    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids), one row a row."""
    kind = dict(docs.dtypes)[id_col]

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        ids, offsets = encode_texts([(b or b"").decode("utf-8", "replace") for b in batch.column(1).to_pylist()], path)
        return [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))]

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    return _mapped(rows, work, f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, ids, decoded), one row a row; null ids are none, and an id that the model lacks is an error."""
    kind = dict(encoded.dtypes)[id_col]

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        lists = batch.column(1)
        flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        return [lists, pa.array([decode_ids(flat[a:b], path) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())]

    rows = encoded.select(F.col(id_col).alias("_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("_ids"))
    return _mapped(rows, work, f"_id {kind}, ids array<int>, decoded string").withColumnRenamed("_id", id_col)


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole text and of what they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    both = decode(encode(documents(spark, sf_dir), path), path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

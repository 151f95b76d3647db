"""Byte-level BPE as a bounded-lookahead streaming transducer (operator 9).

The canonical segmentation of a byte string has one property that makes
streaming possible: a token sequence is canonical exactly when every token on
its own and every pair of neighbours is.  So the last token of every prefix is
fixed by the last tokens of shorter prefixes, and reading one byte adds one
back pointer.  A token is emitted once the sufficient lookahead of the merge list
(:func:`sufficient_lookahead`) has been read after it: nothing that follows can
change it then, so the state is bounded too.

Every text, whatever its length, goes through :class:`StreamingEncoder` in slices of
``SLICE`` characters, and its ids through :class:`StreamingDecoder`.

Defined results: null and empty texts have no tokens; rows are independent of
each other, so repeated rows, null ids and other columns, whatever their names, change
nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.tables import two_columns

# The published split pattern of byte-level BPE vocabularies of this family.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

MEMO_ENTRIES = 700_000
PAIR_ENTRIES = 500_000
MEMO_BYTES = 64
SLICE = 1 << 16


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in vocabulary files: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A vocabulary in bytes: ids, formation ranks and halves of every token."""

    def __init__(self, source: str, pair_entries: int = PAIR_ENTRIES) -> None:
        spec = json.loads(source)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.ids = {raw(token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[bytes, int] = {}
        self.halves: dict[bytes, tuple[bytes, bytes]] = {}
        for n, pair in enumerate(spec["model"]["merges"]):
            left, right = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            if left + right in self.rank:
                raise ValueError("two merges form the same token")
            self.rank[left + right], self.halves[left + right] = n, (left, right)
        self.lookahead = sufficient_lookahead(self)
        self.pair_entries = pair_entries
        self.many = max(self.bytes_of) + 1
        self.pairs: dict[int, bool] = {}
        self._whole: dict[bytes, bool] = {}
        self.usable = {token: i for token, i in self.ids.items() if self.whole(token)}
        self.longest = max(map(len, self.usable))
        by_tail: dict[bytes, set[int]] = {}
        for token in self.usable:
            if len(token) > 2:
                by_tail.setdefault(token[-3:], set()).add(len(token))
        #: The lengths of the tokens that end in three bytes, the longest first.
        self.lengths = {tail: tuple(sorted(found, reverse=True)) + ((2, 1) if tail[1:] in self.usable else (1,)) for tail, found in by_tail.items()}

    def neighbours(self, left: int, right: int) -> bool:
        """Whether two canonical tokens stay apart when they meet; remembered in ``pairs`` under left * many + right."""
        if len(self.pairs) >= self.pair_entries:
            self.pairs.clear()
        known = self.pairs[left * self.many + right] = self._apart(self.bytes_of[left], self.bytes_of[right])
        return known

    def _apart(self, left: bytes, right: bytes) -> bool:
        # Walk the merges of both sides backwards in time.  While a step is
        # undone, the parts that face each other must not have had an earlier
        # merge between them; of equal merges the one further left comes first.
        rank, until = self.rank, len(self.rank)
        while True:
            joint = left + right
            if self.halves.get(joint) == (left, right) and rank[joint] < until:
                return False
            of_left, of_right = rank.get(left, -1), rank.get(right, -1)
            if of_left < 0 and of_right < 0:
                return True
            if of_left > of_right:
                until, left = of_left, self.halves[left][1]
            else:
                until, right = of_right + 1, self.halves[right][0]

    def whole(self, token: bytes) -> bool:
        """Whether a token is its own canonical segmentation."""
        known = self._whole.get(token)
        if known is None:
            halves = self.halves.get(token)
            known = self._whole[token] = halves is None or (self.whole(halves[0]) and self.whole(halves[1]) and self._first_contact(token, *halves))
        return known

    def _first_contact(self, token: bytes, left: bytes, right: bytes) -> bool:
        # The two halves must still be apart when the merge that joins them comes up.
        rank, until = self.rank, self.rank[token]
        while True:
            of_left, of_right = rank.get(left, -1), rank.get(right, -1)
            if of_left < 0 and of_right < 0:
                return True
            if of_left > of_right:
                until, left = of_left, self.halves[left][1]
            else:
                until, right = of_right + 1, self.halves[right][0]
            joint = left + right
            if self.halves.get(joint) == (left, right) and rank[joint] < until:
                return False


def sufficient_lookahead(merges: Merges) -> int:
    """Bytes after a token beyond which nothing can change it.

    Compare a byte string with the same string and something after it while the merges
    are applied in their order.  Both agree up to a place that starts at the end of the
    shorter one, and one merge can move it left by one token only: by its left part,
    where its right part stands on the other side of that place.  That right part then
    begins with what the merge before, of a lower rank, took as its left part.  So the
    furthest reach of a merge is its left part's length and the furthest reach of the
    earlier merges whose left part its right part begins with.
    """
    reach: dict[bytes, int] = {}  # by left part
    for token in sorted(merges.halves, key=merges.rank.__getitem__):
        left, right = merges.halves[token]
        here = len(left) + max(reach.get(right[:i], 0) for i in range(1, len(right) + 1))
        reach[left] = max(reach.get(left, 0), here)
    return max(reach.values(), default=0)


class ByteTransducer:
    """Reads bytes of one pre-token, emits tokens once no continuation can change them."""

    def __init__(self, merges: Merges) -> None:
        self.m = merges
        self.reset()

    def reset(self) -> None:
        self.tail = b""  # the bytes that a next token may still cover
        self.back = [-1]  # the last token of what ends 0, 1, ... bytes after what was emitted; none at the start of the pre-token

    def read(self, data: bytes) -> list[int]:
        """The ids of the tokens that are stable now."""
        m, back, usable, apart, pairs, lengths, many = self.m, self.back, self.m.usable, self.m.neighbours, self.m.pairs, self.m.lengths, self.m.many
        data, read = self.tail + data, len(self.tail)
        most, out = 2 * m.lookahead, []
        for stop in range(read + 1, len(data) + 1):
            held = len(back)
            for n in lengths.get(data[stop - 3 : stop], (2, 1)):
                if n > held:
                    continue
                token = usable.get(data[stop - n : stop])
                if token is None:
                    continue
                left = back[-n]
                if left >= 0:
                    stays = pairs.get(left * many + token)
                    if stays is None:
                        stays = apart(left, token)
                    if not stays:
                        continue
                back.append(token)
                break
            else:
                raise ValueError("the vocabulary lacks a single byte")
            if held >= most:
                out += self._last(self._stable(held - m.lookahead))
        self.tail = data[-m.longest :]
        return out

    def _stable(self, limit: int) -> int:
        # The last end of a token that isn't beyond the limit, counted from what was emitted.
        end = len(self.back) - 1
        while end > limit:
            end -= len(self.m.bytes_of[self.back[end]])
        return max(end, 0)

    def _last(self, end: int) -> list[int]:
        # The tokens up to an end; the last of them is still the left neighbour of what follows.
        out, at = [], end
        while at > 0:
            out.append(self.back[at])
            at -= len(self.m.bytes_of[out[-1]])
        del self.back[:end]
        out.reverse()
        return out

    def rest(self) -> list[int]:
        """The ids of the rest of the pre-token."""
        out = self._last(len(self.back) - 1)
        self.reset()
        return out

    def feed(self, data: bytes) -> Iterator[bytes]:
        return map(self.m.bytes_of.__getitem__, self.read(data))

    def finish(self) -> Iterator[bytes]:
        return map(self.m.bytes_of.__getitem__, self.rest())


class Encoder:
    """Pre-tokens to their ids in some form.  Short ones are remembered, as they recur; the memo is bounded."""

    def __init__(self, merges: Merges, memo_entries: int = MEMO_ENTRIES, form: Callable[[tuple[int, ...]], object] = tuple) -> None:
        self.m, self.memo_entries, self.form = merges, memo_entries, form
        self.split = regex.compile(SPLIT_PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None
        self.memo: dict[str, object] = {}
        self.bytes = ByteTransducer(merges)

    def one(self, pre_token: str) -> object:
        found = self.form((*self.bytes.read(pre_token.encode()), *self.bytes.rest()))
        if len(pre_token) <= MEMO_BYTES:
            if len(self.memo) >= self.memo_entries:
                self.memo.clear()
            self.memo[pre_token] = found
        return found

    def words(self, pre_tokens: list[str]) -> list:
        memo, one = self.memo, self.one
        return [memo[w] if w in memo else one(w) for w in pre_tokens]

    def pieces(self, text: str | None) -> Iterator[list]:
        """The ids of a text in their form, slice after slice."""
        stream = StreamingEncoder(self)
        text = text or ""
        for at in range(0, len(text), SLICE):
            yield from stream.pieces(text[at : at + SLICE], last=at + SLICE >= len(text))
        yield from stream.closing()

    def ids(self, text: str | None) -> Iterator[int]:
        return chain.from_iterable(chain.from_iterable(self.pieces(text)))


def drawn(merges: Merges) -> Callable[[tuple[int, ...]], tuple[str, bytes]]:
    """The form of ids for digests: what is written of them, and their bytes."""
    return lambda ids: (",".join(map(str, ids)), b"".join(map(merges.bytes_of.__getitem__, ids)))


class StreamingEncoder:
    """Chunks of text to ids, holding back only what a later chunk could change.

    A pre-token is settled three characters before the end of what has been
    read: contractions look that far.  A run that is longer than ``hold`` goes
    to the byte transducer piecemeal, so memory stays constant there too.
    """

    KINDS = tuple(regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+"))

    def __init__(self, encoder: Encoder, hold: int = 4096) -> None:
        self.encoder, self.hold = encoder, hold
        self.buffer, self.run = "", None
        self.guard = max([3, *(len(s) + 2 for s in encoder.m.special)])  # white space also looks at what follows

    def _bytes(self, text: str) -> list:
        """What the byte transducer gives of a part of a long run."""
        found = tuple(self.encoder.bytes.read(text.encode()))
        return [self.encoder.form(found)] if found else []

    def closing(self) -> Iterator[list]:
        """The rest of a long run."""
        if self.run is not None:
            self.run = None
            yield [self.encoder.form(tuple(self.encoder.bytes.rest()))]

    def pieces(self, chunk: str, last: bool = False) -> Iterator[list]:
        """What is settled now, in the encoder's form."""
        self.buffer += chunk
        enc, specials = self.encoder, self.encoder.special
        while self.buffer:
            limit = len(self.buffer) if last else len(self.buffer) - self.guard
            if limit <= 0:
                break
            mark = specials.search(self.buffer) if specials else None
            if mark and mark.start() == 0:
                yield from self.closing()
                yield [enc.form((enc.m.special[mark.group()],))]
                self.buffer = self.buffer[mark.end() :]
                continue
            stop = mark.start() if mark else len(self.buffer)
            final = last or mark is not None
            if self.run is not None:
                more = self.run.match(self.buffer, 0, stop)
                n = more.end() if more else 0
                open_ended = not final and (n == stop or n > limit)  # a special token may have begun
                if self.run is self.KINDS[3] and n and not open_ended and n < stop:
                    n -= 1  # white space leaves its last character to what follows
                n = min(n, limit) if open_ended else n
                yield self._bytes(self.buffer[:n])
                self.buffer = self.buffer[n:]
                if open_ended:
                    break
                yield from self.closing()
                continue
            words, end = enc.split.findall(self.buffer, 0, stop), stop
            if not final:
                while words and end > limit:
                    end -= len(words.pop())
            if words:
                yield enc.words(words)
                self.buffer = self.buffer[end:]
                continue
            found = enc.split.match(self.buffer, 0, stop)
            if len(self.buffer) <= self.hold or found.end() <= self.guard:
                break
            head = 1 if self.buffer[0] == " " and len(self.buffer) > 1 and not self.buffer[1].isspace() else 0
            self.run = next(k for k in self.KINDS if k.match(self.buffer, head))
            yield self._bytes(self.buffer[: head + 1])
            self.buffer = self.buffer[head + 1 :]

    def feed(self, chunk: str) -> Iterator[int]:
        return chain.from_iterable(chain.from_iterable(self.pieces(chunk)))

    def finish(self) -> Iterator[int]:
        return chain.from_iterable(chain.from_iterable(chain(self.pieces("", last=True), self.closing())))


class StreamingDecoder:
    """Ids to text, holding back at most the bytes of one unfinished character."""

    def __init__(self, merges: Merges) -> None:
        self.bytes_of = merges.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.feed_bytes(b"".join(map(self.bytes_of.__getitem__, ids)))

    def feed_bytes(self, raw: bytes) -> str:
        return self.state.decode(raw)

    def finish(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(maxsize=2)
def drawn_for(source: str, memo_entries: int = MEMO_ENTRIES) -> Encoder:
    """An encoder for digests that a Python worker keeps from task to task, with what it remembers."""
    merges = Merges(source, min(PAIR_ENTRIES, memo_entries))
    return Encoder(merges, memo_entries, drawn(merges))


@lru_cache(maxsize=2)
def encoder_for(source: str, memo_entries: int = MEMO_ENTRIES) -> Encoder:
    """The same for ids."""
    return Encoder(Merges(source, min(PAIR_ENTRIES, memo_entries)), memo_entries)


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every text: ``id_col``, ``ids array<int>``."""
    spark = df.sparkSession
    shipped = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))  # one vocabulary file: its size doesn't follow the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_for(shipped.value)
        for batch in batches:
            ids = [list(enc.ids(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    src = two_columns(df, id_col, text_col)
    return src.mapInArrow(run, f"{id_col} {src.dtypes[0][1]}, ids array<int>")


def decode(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Text of every id list: ``id_col``, ``text``.  A null list decodes to an empty text."""
    shipped = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges(shipped.value)
        for batch in batches:
            out = []
            for ids in batch.column(1).to_pylist():
                dec = StreamingDecoder(merges)
                out.append(dec.feed(ids or ()) + dec.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [id_col, "text"])

    src = df.select(F.col(id_col), F.col(ids_col).alias("ids"))
    return src.mapInArrow(run, f"{id_col} {src.dtypes[0][1]}, text string")


def round_trip_digests(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", memo_entries: int = MEMO_ENTRIES, keep_encoder: bool = True) -> DataFrame:
    """Encode and decode in one pass over the rows; digests of ids and decoded text per row.

    Workers that go on to other work give the encoder's memory back with ``keep_encoder=False``, and build it again for each task.
    """
    shipped = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = drawn_for(shipped.value, memo_entries)
        for batch in batches:
            count, of_ids, of_text = [], [], []
            for cell in batch.column(1):
                dec, ids_hash, text_hash, n = StreamingDecoder(enc.m), hashlib.sha256(), hashlib.sha256(), 0
                for piece in enc.pieces(cell.as_py()):
                    written = ",".join([x for x, _ in piece if x])
                    if written:
                        ids_hash.update((("," if n else "") + written).encode())
                        text_hash.update(dec.feed_bytes(b"".join([x for _, x in piece])).encode())
                        n += written.count(",") + 1
                text_hash.update(dec.finish().encode())
                count.append(n)
                of_ids.append(ids_hash.hexdigest())
                of_text.append(text_hash.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(of_ids), pa.array(of_text)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
        if not keep_encoder:
            drawn_for.cache_clear()

    src = two_columns(df, id_col, text_col)
    return src.mapInArrow(run, f"{id_col} {src.dtypes[0][1]}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 9 over all of ``documents``."""
    return round_trip_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary_path())

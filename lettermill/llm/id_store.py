"""Token ids in a compressed, checksummed binary store.

*Writing.* Documents are put in order of their ids by ranges; a task encodes the texts of its
range, appends the end id to each, and cuts the stream of ids into segments of whole
documents with SEGMENT_IDS ids or more. A segment is one row of the store: its place in the
order, the ids of its documents, and ``payload``, the file format below. The store is written
by Spark's own writer, so lost tasks are repeated and nothing partial is ever read.

*Payload* (little-endian):

    magic "LMID", version u16, end id u32, documents u32, ids u64, block size u32, blocks u32,
    distinct ids u32, length of the packed tables u32, length of the code words of all blocks u32
    packed tables (zlib): tokens of each document u64, distinct ids u32, their frequencies u32,
        per block: code words u32, CRC-32 of its ids u32
    CRC-32 of all of the above u32
    code words u16 of block 0, block 1, ...

*Blocks* of equally many ids are coded independently of each other: models and coder start anew,
so a damaged block is found by its checksum and costs no other. Three predictions are mixed for
each id:

* order 2: the id that followed the last two ids before, in a hashed table with a confidence;
* order 1: the same for the last id alone;
* order 0: the frequencies of the segment, from the tables above.

The weights of the mix adapt within the block: for every pair of confidences (and whether the two
orders agree) they are the running shares of ids that order 2 had right, that order 1 had
right, and the rest. A range coder (64-bit state, 16-bit words, no carries) codes the id's part of the mix: all of
order 2's weight, all of order 1's, or what is left times the id's order-0 frequency.

A block cannot be coded faster than one id after the other, so all blocks of a segment advance
together: every step is a NumPy operation over one id of each block.

*Reading* decodes segments wherever they are; each names its documents, so any split will do.

Defined cases: null text is the empty text, only the end id is written; null doc_ids come
first; documents of equal ids stand next to each other in an order given by their ids' hash and
are rows of their own; other columns are not looked at; an empty table gives an empty store
and no rows; one very long text is one segment of many blocks; a payload that was changed is an error.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe_codec import CACHE_WORDS, LATIN_END, LONG_WORD, Splitter, byte_symbols, refuse_other_settings
from .common import new_work_path, small
from .token_counts import lowered

SEGMENT_IDS = 1 << 22
BLOCK_IDS = 1024
MIN_BLOCK_IDS = 128
LANES = 4096
END_ID = 2
TEXT_AT_ONCE = 1 << 23  # bytes of text that are cut into pre-tokens at once
WORDS_AT_ONCE = 1000  # new pre-tokens that the library gets at once
CODED_BYTES = {"latin-1": 1, "utf-16-le": 2, "utf-32-le": 4}

MAGIC, VERSION = b"LMID", 1
HEAD = "<4sHIIQIIIII"
HEAD_SIZE = struct.calcsize(HEAD)

# The pattern of the vocabulary's pre-tokeniser; letters, which no other
# alternative can begin with, are tried first.
WORD_PATTERN = r"""[\p{L}]+|'s|'t|'re|'ve|'m|'ll|'d|[\p{N}]|[^\s\p{L}\p{N}]+"""

TABLE_BITS = 10  # entries of each order's table
CONFIDENCE_BITS = 3
SHARE_BITS, FREQUENCY_BITS = 14, 18  # an id's interval is a part of 2**32
SHARE, FREQUENCY = 1 << SHARE_BITS, 1 << FREQUENCY_BITS
RATE = 5  # weights move by 1/32 of the gap
GAIN = SHARE // 32 - 6  # both weights together stay below SHARE
ROWS_TURNED = 32
FIELD = 16  # order 2's weight stands above order 1's in one integer

U = np.uint64
LIMIT, BELOW, OUT = U(1 << 48), U((1 << 48) - 1), U(16)


# --- the mix of predictions ------------------------------------------------------------


class Mix:
    """Order-1 and order-2 predictions of ``lanes`` independent blocks, and their weights.

    Ids are numbers into ``codes``, whose first is id 0. A table entry is such a number and how
    often it was right of late, CONFIDENCE_BITS of it. Right: surer. Wrong: half as sure, and
    replaced when no trust is left. Row 0 of two-row arrays is order 1, row 1 order 2.
    """

    def __init__(self, lanes: int, codes: np.ndarray):
        entries = 1 << TABLE_BITS
        # Half the bytes if they will do: the tables are what does not fit into a core's cache.
        self.kind = np.dtype(np.uint16 if len(codes) <= 1 << (16 - CONFIDENCE_BITS) else np.uint32)
        self.entries = np.zeros(2 * lanes * entries, self.kind)
        self.base = np.arange(2 * lanes, dtype=np.int64).reshape(2, lanes) * entries
        cells = 2 << (2 * CONFIDENCE_BITS)
        self.cells = np.arange(lanes, dtype=np.int64) * cells
        self.weights = np.full(lanes * cells, (SHARE // 4) << FIELD | SHARE // 4, dtype=np.uint32)
        self.hashes = codes.astype(np.uint32) * np.uint32(0x9E3779B1)
        self.last, self.before = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.top = self.kind.type((1 << CONFIDENCE_BITS) - 1)
        self.body = self.kind.type(np.iinfo(self.kind).max - self.top)
        self.gain = np.array([0, GAIN, GAIN << FIELD], dtype=np.uint32)
        self.decay = np.uint32(((SHARE - 1) >> RATE) << FIELD | ((SHARE - 1) >> RATE))

    def predict(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The weights of orders 2 and 1 for the first ``n`` lanes; ``entry`` holds their predictions."""
        shift = np.uint32(32 - TABLE_BITS)
        last = self.last[:n]
        at = np.empty((2, n), np.int64)
        np.add(self.base[0, :n], last >> shift, out=at[0])
        np.add(self.base[1, :n], (last * np.uint32(0x85EBCA6B) ^ self.before[:n]) >> shift, out=at[1])
        entry = self.entries.take(at, mode="clip")  # all are in range; saves the check
        sure = entry & self.top
        cell = sure[1] << (CONFIDENCE_BITS + 1)
        cell |= sure[0] << 1
        cell |= (entry[0] ^ entry[1]) <= self.top  # the two agree
        self.at_weight = self.cells[:n] + cell
        weight = self.weights.take(self.at_weight)
        self.at, self.entry, self.sure, self.weight = at, entry, sure, weight
        return weight >> np.uint32(FIELD), weight & np.uint32((1 << FIELD) - 1)

    def right(self, now: np.ndarray) -> np.ndarray:
        """Which orders were right about the numbers ``now`` that came."""
        self.fresh = now << CONFIDENCE_BITS
        self.gap = self.entry ^ self.fresh
        return self.gap <= self.top

    def learn(self, n: int, now: np.ndarray, who: np.ndarray, right: np.ndarray) -> None:
        """Adapt to the numbers that came; ``who`` had them: 2, 1 or 0 (none)."""
        weight, sure = self.weight, self.sure
        self.weights[self.at_weight] = weight - ((weight >> np.uint32(RATE)) & self.decay) + self.gain.take(who)
        doubt = sure == 0
        down = sure >> 1
        down += doubt  # of the entry that takes its place
        up = np.minimum(sure + self.kind.type(1), self.top)
        up -= down
        up *= right
        up += down
        stays = np.logical_or(doubt, right, out=doubt).astype(self.kind)
        stays -= self.kind.type(1)  # all bits where the entry's number stays, none where ``now`` comes
        stays &= self.gap
        stays &= self.body
        stays ^= self.fresh
        stays |= up
        self.entries[self.at] = stays
        self.before[:n] = self.last[:n] * np.uint32(0xC2B2AE35)
        self.last[:n] = self.hashes.take(now)


def order_zero(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids and frequencies that add up to FREQUENCY, none 0."""
    distinct, counts = np.unique(ids, return_counts=True)
    if len(distinct) > FREQUENCY // 2 or (len(ids) and distinct[-1] >> (31 - CONFIDENCE_BITS)):
        raise ValueError(f"more than {FREQUENCY // 2} distinct ids in a segment, or ids of more than 28 bits")
    if len(counts):
        counts = counts * (FREQUENCY - len(distinct)) // counts.sum() + 1
        counts[np.argmax(counts)] += FREQUENCY - counts.sum()
    return distinct, counts


# --- the range coder over many blocks ---------------------------------------------------


class Coder:
    """Range coders of several lanes: ``low`` and ``range`` of 64 bits, output in 16-bit words."""

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, dtype=U)
        self.range = np.full(lanes, ~U(0), dtype=U)

    def narrow(self, n: int, unit: np.ndarray, begin: np.ndarray, width: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keep [begin, begin + width) units of the first ``n`` lanes.

        Gives lanes with a settled leading word and these words, as often as there are any.
        A range that has less than LIMIT left is cut where its leading word would change.
        """
        low, span = self.low[:n], self.range[:n]
        low += unit * begin
        np.multiply(unit, width, out=span)
        out = (span < LIMIT).nonzero()[0]
        while len(out):
            old = low[out]
            rest = old & BELOW
            left = np.minimum(span[out], LIMIT - rest) << OUT
            low[out], span[out] = rest << OUT, left
            yield out, old >> U(48)
            out = out[left < LIMIT]


def _numbered(distinct: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids by number, id 0 always the first, and of each the order-0 interval's begin and width.

    One more interval, the last, is the whole: that of ids which order 1 or 2 had right.
    """
    if not len(distinct) or distinct[0]:
        distinct, frequency = np.append(0, distinct), np.append(0, frequency)
    upto = np.cumsum(frequency) - frequency
    return distinct, np.append(upto, 0).astype(np.uint32), np.append(frequency, FREQUENCY).astype(np.uint32)


def _intervals(
    two_has: np.ndarray, one_has: np.ndarray, two: np.ndarray, one: np.ndarray, upto: np.ndarray, frequency: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Where the interval of an id begins in 2**32 and its width, by who had it.

    Weights adapt but never get to 0, so no width is 2**32 and 32 bits hold all of them.
    """
    known = two + one
    share = np.where(two_has, two, np.where(one_has, one, np.uint32(SHARE) - known))
    begin = np.where(two_has, np.uint32(0), np.where(one_has, two, known))
    begin <<= np.uint32(FREQUENCY_BITS)
    begin += share * upto
    share *= frequency
    return begin, share


def _turned(rows: np.ndarray) -> np.ndarray:
    """``rows`` transposed in memory, a few rows at a time: these stay in the core's cache."""
    out = np.empty(rows.shape[::-1], rows.dtype)
    for at in range(0, len(rows), ROWS_TURNED):
        out[:, at : at + ROWS_TURNED] = rows[at : at + ROWS_TURNED].T
    return out


def _starts(n_ids: int, block: int) -> np.ndarray:
    return np.arange(0, n_ids, block, dtype=np.int64)


def encode_blocks(ids: np.ndarray, block: int, distinct: np.ndarray, frequency: np.ndarray) -> list[np.ndarray]:
    """The code words of every block of ``block`` ids; the last block may be shorter."""
    starts = _starts(len(ids), block)
    codes, upto, frequency = _numbered(distinct, frequency)
    lanes = len(starts)
    mix, coder, predicted = Mix(lanes, codes), Coder(lanes), len(codes)
    place = np.zeros(int(codes[-1]) + 1, dtype=mix.kind)
    place[codes] = np.arange(len(codes))
    # By step, then by block: each step reads one row.
    steps = np.zeros((lanes, block), dtype=mix.kind)
    steps.ravel()[: len(ids)] = place[ids]
    steps = _turned(steps)
    last_length = len(ids) - starts[-1]
    sent_lanes, sent_words = [], []
    for step in range(min(block, len(ids))):
        # Only the last block can be shorter, so lanes in use are the first n.
        n = lanes if step < last_length else lanes - 1
        now = steps[step, :n]
        w_two, w_one = mix.predict(n)
        right = mix.right(now)
        one_right, two_right = right
        number = now.astype(np.int64)
        at = np.where(one_right | two_right, predicted, number)
        begin, width = _intervals(two_right, one_right, w_two, w_one, upto.take(at), frequency.take(at))
        for out, words in coder.narrow(n, coder.range[:n] >> U(32), begin, width):
            sent_lanes.append(out.astype(np.uint32))
            sent_words.append(words.astype(np.uint16))
        mix.learn(n, number, (two_right.view(np.int8) << 1 | (one_right > two_right)).astype(np.int64), right)
    # Four words of ``low`` end a block.
    everyone = np.arange(lanes, dtype=np.uint32)
    for shift in (48, 32, 16, 0):
        sent_lanes.append(everyone)
        sent_words.append(((coder.low >> U(shift)) & U(0xFFFF)).astype(np.uint16))
    lane, word = np.concatenate(sent_lanes), np.concatenate(sent_words)
    order = np.argsort(lane.astype(np.uint16 if lanes <= 1 << 16 else np.int64), kind="stable")
    return np.split(word[order].astype("<u2"), np.cumsum(np.bincount(lane, minlength=lanes))[:-1])


def decode_blocks(
    words: np.ndarray, counts: np.ndarray, n_ids: int, block: int, distinct: np.ndarray, frequency: np.ndarray
) -> np.ndarray:
    """The ids of blocks whose code words stand in ``words``, ``counts`` of them per block."""
    starts = _starts(n_ids, block)
    codes, upto, frequency = _numbered(distinct, frequency)
    lanes = len(starts)
    mix, coder, predicted = Mix(lanes, codes), Coder(lanes), len(codes)
    slots = np.repeat(np.arange(predicted, dtype=mix.kind), frequency[:-1])
    words = np.append(words, np.zeros(4, words.dtype))
    at_word, code = np.cumsum(counts) - counts, np.zeros(lanes, dtype=U)

    def take(which: np.ndarray) -> None:
        """One more word for the lanes ``which``; a damaged block may ask for more than it has."""
        place = at_word[which]
        code[which] = code[which] << OUT | words.take(place, mode="clip")
        at_word[which] = place + 1

    for _ in range(4):
        take(np.arange(lanes))
    last_length = n_ids - starts[-1]
    steps = np.zeros((block, lanes), dtype=mix.kind)
    bits = np.uint32(FREQUENCY_BITS)
    for step in range(min(block, n_ids)):
        n = lanes if step < last_length else lanes - 1
        w_two, w_one = mix.predict(n)
        unit = coder.range[:n] >> U(32)
        # Beyond 32 bits only in damaged blocks.
        target = ((code[:n] - coder.low[:n]) // unit).astype(np.uint32)
        known = w_two + w_one
        somebody = target < known << bits
        two_has = target < w_two << bits
        slot = (target - (known << bits)) // (np.uint32(SHARE) - known)
        nobody = slots.take(slot.astype(np.int64), mode="clip").astype(np.int64)
        one, two = mix.entry >> CONFIDENCE_BITS
        number = np.where(somebody, np.where(two_has, two, one), nobody)
        at = np.where(somebody, predicted, nobody)
        begin, width = _intervals(two_has, somebody, w_two, w_one, upto.take(at), frequency.take(at))
        for out, _ in coder.narrow(n, unit, begin, width):
            take(out)
        now = steps[step, :n]
        now[:] = number
        mix.learn(n, number, (two_has.view(np.int8) << 1 | (somebody > two_has)).astype(np.int64), mix.right(now))
    return codes[_turned(steps).ravel()[:n_ids]]


# --- segments ----------------------------------------------------------------------------


class Damaged(ValueError):
    """A payload or one of its blocks is not what was written."""


def pack(documents: list[bytes], end_id: int = END_ID) -> bytes:
    """The payload of documents given as ids in little-endian 32-bit integers, end ids included."""
    return pack_ids(np.frombuffer(b"".join(documents), dtype="<u4"), np.array([len(d) // 4 for d in documents]), end_id)


def pack_ids(ids: np.ndarray, sizes: np.ndarray, end_id: int = END_ID) -> bytes:
    """The payload of the ids of documents one after the other, ``sizes`` of them each, end ids included."""
    block = int(np.clip(-(-len(ids) // LANES), MIN_BLOCK_IDS, BLOCK_IDS))
    distinct, frequency = order_zero(ids)
    words = encode_blocks(ids, block, distinct, frequency) if len(ids) else []
    raw = ids.astype("<u4", copy=False)
    sums = [zlib.crc32(raw[a : a + block].tobytes()) for a in range(0, len(ids), block)]
    tables = [
        sizes.astype("<u8"),
        distinct.astype("<u4"),
        frequency.astype("<u4"),
        np.array([len(w) for w in words], dtype="<u4"),
        np.array(sums, dtype="<u4"),
    ]
    packed = zlib.compress(b"".join(t.tobytes() for t in tables))
    n_words = sum(map(len, words))
    head = struct.pack(
        HEAD, MAGIC, VERSION, end_id, len(sizes), len(ids), block, len(words), len(distinct), len(packed), n_words
    )
    front = head + packed
    return b"".join([front, struct.pack("<I", zlib.crc32(front)), *[w.tobytes() for w in words]])


def unpack(payload: bytes) -> list[np.ndarray]:
    """The ids of each document of a payload; every block is held against its checksum."""
    if len(payload) < HEAD_SIZE + 4 or payload[:4] != MAGIC:
        raise Damaged("not a payload of token ids")
    _, version, _, n_docs, n_ids, block, n_blocks, n_distinct, n_packed, n_words = struct.unpack_from(HEAD, payload)
    at = HEAD_SIZE + n_packed
    if version != VERSION or len(payload) != at + 4 + 2 * n_words:
        raise Damaged("another version, or a payload cut short")
    if struct.unpack_from("<I", payload, at)[0] != zlib.crc32(payload[:at]):
        raise Damaged("the tables of a payload have changed")
    tables, place = zlib.decompress(payload[HEAD_SIZE : at]), 0

    def column(n: int, kind: str) -> np.ndarray:
        nonlocal place
        out = np.frombuffer(tables, dtype=kind, count=n, offset=place)
        place += out.nbytes
        return out.astype(np.int64)

    sizes, distinct, frequency = column(n_docs, "<u8"), column(n_distinct, "<u4"), column(n_distinct, "<u4")
    counts, sums = column(n_blocks, "<u4"), column(n_blocks, "<u4")
    words = np.frombuffer(payload, dtype="<u2", offset=at + 4)
    ids = decode_blocks(words, counts, n_ids, block, distinct, frequency).astype("<u4") if n_ids else np.empty(0, "<u4")
    for i, expected in enumerate(sums.tolist()):
        if zlib.crc32(ids[i * block : (i + 1) * block].tobytes()) != expected:
            raise Damaged(f"block {i} of a payload has changed")
    return np.split(ids, np.cumsum(sizes)[:-1]) if n_docs else []


# --- tokens ------------------------------------------------------------------------------


class Words:
    """Ids of texts, by the library's own model, many texts at once.

    A pre-token's ids do not depend on its surroundings, so each distinct one is encoded once and
    has a row: ``begins`` and ``lengths`` name its ids in ``ids``. Rows of the end id and
    the special strings come first. Texts are cut into pre-tokens by the kinds of their characters.
    """

    def __init__(self, content: str, end_id: int = END_ID):
        # One task has one core: the library is to start no threads.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        library = Tokenizer.from_str(content)
        self.model = library.model.tokenize
        self.symbols = np.array([ord(c) for c in byte_symbols()], dtype="<u2")
        self.symbols[0x20] = 0x20  # no pre-token has a space; it stands between them
        special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        self.splitter = Splitter(WORD_PATTERN, special)
        self.special = {text: row for row, text in enumerate(special, 1)}
        self.first_ids = [end_id, *special.values()]
        suffix = json.loads(content)["model"].get("end_of_word_suffix")
        self.bare, self.ends = None, None
        if suffix:
            self.bare = Tokenizer(library.model)
            self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            vocabulary = self.bare.get_vocab(with_added_tokens=False)
            self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.kinds = np.empty(0, np.uint8)
        self._start()

    def _start(self) -> None:
        n = len(self.first_ids)
        # By coding: pre-tokens that have a row, these rows, and when each came last.
        self.known: dict[str, tuple[pa.Array, np.ndarray, np.ndarray]] = {}
        self.time = 0
        self.ids, self.begins, self.lengths = np.array(self.first_ids, "<u4"), np.arange(n), np.ones(n, np.int64)

    def _forget(self) -> None:
        """Keep the rows of at most CACHE_WORDS pre-tokens of each coding, those that came last."""
        n = len(self.first_ids)
        kept = [np.arange(n)]
        for coding, (words, rows, came) in self.known.items():
            late = came > (np.partition(came, -CACHE_WORDS - 1)[-CACHE_WORDS - 1] if len(came) > CACHE_WORDS else 0)
            kept.append(rows[late])
            self.known[coding] = words.filter(pa.array(late)), np.arange(n, n + len(kept[-1])), came[late]
            n += len(kept[-1])
        kept = np.concatenate(kept)
        self.ids, self.lengths = self._ids_of(kept), self.lengths[kept]
        self.begins = np.cumsum(self.lengths) - self.lengths
        if len(self.ids) >= 16 * CACHE_WORDS:
            self._start()

    def _ids_of(self, rows: np.ndarray) -> np.ndarray:
        """The ids of ``rows``, one after the other."""
        lengths = self.lengths[rows]
        upto = np.cumsum(lengths)
        return self.ids[np.arange(upto[-1]) + np.repeat(self.begins[rows] - upto + lengths, lengths)]

    def _kinds(self, top: int) -> np.ndarray:
        """Kind of each character up to ``top``: white space 0, letter 1, number 2, other 3."""
        if top >= len(self.kinds):
            size = next(n for n in (LATIN_END, 1 << 16, 0x110000) if n > top)
            codes = [c for c in range(size) if not 0xD800 <= c < 0xE000]
            text, self.kinds = "".join(map(chr, codes)), np.full(size, 3, dtype=np.uint8)
            for kind, pattern in enumerate((r"\s", r"\p{L}", r"\p{N}")):
                self.kinds[[ord(c) for c in regex.findall(pattern, text)]] = kind
        return self.kinds

    def _cut(self, text: str) -> tuple[np.ndarray, bytes, np.ndarray, str]:
        """Where pre-tokens begin in ``text``.

        Returned with these places: the characters outside white space, coded with equally many
        bytes each; where pre-tokens begin among these characters; the coding.
        """
        n = len(text)
        kind = np.zeros(n + 3, np.uint8)  # white space behind the text
        try:
            raw, coding = text.encode("latin-1"), "latin-1"
            kinds = self._kinds(255)[:256]
            codes, kept = np.frombuffer(raw, np.uint8), raw.translate(None, np.flatnonzero(kinds == 0).astype(np.uint8).tobytes())
            kind[:n] = np.frombuffer(raw.translate(kinds.tobytes()), np.uint8)
        except UnicodeEncodeError:
            codes, coding = np.frombuffer(text.encode("utf-32-le"), "<u4"), "utf-32-le"
            top = int(codes.max())
            if top < 1 << 16:
                codes, coding = codes.astype("<u2"), "utf-16-le"
            kind[:n] = self._kinds(top)[codes]
            kept = codes[kind[:n] != 0].tobytes()
        begin = kind == 2  # numbers are cut one by one
        begin[0] = True
        begin[1:] |= kind[1:] != kind[:-1]
        begin &= kind != 0
        # An apostrophe that begins a run may begin 's, 't, 're, 've, 'm, 'll or 'd.
        quote = np.flatnonzero(codes == 0x27)
        quote = quote[begin[quote]]
        one, two = (codes[np.minimum(quote + i, n - 1)] * (quote + i < n) for i in (1, 2))
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        begin[quote[short | long] + 1] = False
        after = np.append(quote[short] + 2, quote[long] + 3)
        begin[after] = kind[after] != 0
        return np.flatnonzero(begin), kept, np.flatnonzero(begin[kind != 0]), coding

    def _add(self, words: list[bytes], coding: str) -> np.ndarray:
        """Encode pre-tokens that have no row; their rows."""
        found, lengths, space = [], [], " ".encode(coding)
        for at in range(0, len(words), WORDS_AT_ONCE):
            some = words[at : at + WORDS_AT_ONCE]
            raw = space.join(some).decode(coding).encode("utf-8")
            letters = self.symbols[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-16-le")
            if self.bare:
                # Tokens of pre-tokens one after the other; one with the end mark ends each.
                ids = np.array(self.bare.encode_batch_fast([letters], add_special_tokens=False)[0].ids, dtype="<u4")
                last = np.flatnonzero(self.ends[ids])
                if len(last) == len(some) and len(ids) == last[-1] + 1:
                    found.append(ids)
                    lengths.append(np.diff(last, prepend=-1))
                    continue
            each = [[t.id for t in self.model(x)] for x in letters.split(" ")]
            found.append(np.array([i for ids in each for i in ids], dtype="<u4"))
            lengths.append(np.array([len(ids) for ids in each], dtype=np.int64))
        rows = np.arange(len(words)) + len(self.lengths)
        lengths = np.concatenate(lengths)
        self.begins = np.concatenate([self.begins, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, *found])
        return rows

    def _rows(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The row of every pre-token of ``text`` and where it begins."""
        if not text:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at, kept, first, coding = self._cut(text)
        # Distinct pre-tokens by their characters.
        size, kind = CODED_BYTES[coding], pa.large_binary()
        buffers = [None, pa.py_buffer(np.append(first * size, len(kept))), pa.py_buffer(kept)]
        coded = pa.Array.from_buffers(kind, len(first), buffers).dictionary_encode()
        distinct = coded.dictionary
        if not len(distinct):
            return np.empty(0, np.int64), at
        none = np.empty(0, np.int64)
        words, rows_of, came = self.known.get(coding, (pa.array([], kind), none, none))
        self.time += 1
        place = pc.index_in(distinct, value_set=words).fill_null(-1).to_numpy()
        old, new = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        rows = np.empty(len(distinct), np.int64)
        rows[old] = rows_of[place[old]]
        came[place[old]] = self.time
        if len(new):
            fresh = distinct.take(pa.array(new))
            rows[new] = self._add(fresh.to_pylist(), coding)
            short = np.flatnonzero(pc.binary_length(fresh).to_numpy() <= LONG_WORD * size)
            words = pa.concat_arrays([words, fresh.take(pa.array(short))])
            rows_of = np.append(rows_of, rows[new[short]])
            self.known[coding] = words, rows_of, np.append(came, np.full(len(short), self.time))
        return rows[coded.indices.to_numpy()], at

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and how many each has."""
        if any(len(rows) >= 2 * CACHE_WORDS for _, rows, _ in self.known.values()) or len(self.ids) >= 16 * CACHE_WORDS:
            self._forget()
        plain, tails = [], []  # stretches without special strings, and the row that comes after each
        for text in texts:
            cut = self.splitter.segments(text)
            plain.extend(map(lowered, cut[::2]))
            tails.extend([self.special[x] for x in cut[1::2]])
            tails.append(0)
        tails = np.array(tails, dtype=np.int64)
        # A line break belongs to no pre-token, so none goes on from one stretch to the next.
        rows, at = self._rows("\n".join(plain))
        borders = np.cumsum([len(x) + 1 for x in plain])
        ends = np.searchsorted(at, borders)
        rows = np.insert(rows, ends, tails)
        last = np.cumsum(self.lengths[rows])[(ends + np.arange(len(ends)))[tails == 0]]
        return self._ids_of(rows), np.diff(last, prepend=0)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0][:-1].tobytes()


def held_words(vocabulary: dict, end_id: int) -> Words:
    """The Words of a vocabulary's ``content``, kept in ``vocabulary`` once made."""
    if "words" not in vocabulary:
        vocabulary["words"] = Words(vocabulary["content"], end_id)
    return vocabulary["words"]


def runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First and end rows of runs of texts with TEXT_AT_ONCE bytes or, where one text has more, of that text."""
    ends, first = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while first < len(texts):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + TEXT_AT_ONCE, side="right")))
        yield first, last
        first = last


# --- Spark -------------------------------------------------------------------------------


def segments(docs: DataFrame, vocabulary_path: str, id_col: str, text_col: str, end_id: int, segment_ids: int) -> DataFrame:
    """(part, segment, doc_ids, n_tokens, payload) in ascending order of documents."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    # Equal ids are dealt by text, so no id is one task; parts number the ranges in order.
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text"), F.col("text")]
    ordered = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    kind = rows.schema["doc_id"].dataType.simpleString()
    with open(vocabulary_path, encoding="utf-8") as file:
        content = file.read()
    refuse_other_settings(json.loads(content))
    # What a Python worker builds from the vocabulary stays with its copy, for its further tasks.
    vocabulary = docs.sparkSession.sparkContext.broadcast({"content": content})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, names, ids, sizes, held, made = None, [], [], [], 0, 0

        def row(part: int, kind: pa.DataType) -> pa.RecordBatch:
            lengths = np.concatenate(sizes)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([made], pa.int64()),
                    pa.array([names], pa.list_(kind)),
                    pa.array([lengths.tolist()], pa.list_(pa.int64())),
                    pa.array([pack_ids(np.concatenate(ids), lengths, end_id)], pa.binary()),
                ],
                ["part", "segment", "doc_ids", "n_tokens", "payload"],
            )

        for batch in batches:
            words = words or held_words(vocabulary.value, end_id)
            part, kind = batch.column(0)[0].as_py(), batch.column(1).type
            for first, last in runs(batch.column(2)):
                found, lengths = words.encode_all(batch.column(2)[first:last].to_pylist())
                upto, at, done = np.cumsum(lengths), 0, 0
                while at < len(lengths):
                    # Whole documents until there are ``segment_ids`` ids or more.
                    end = int(np.searchsorted(upto, done + segment_ids - held)) + 1
                    stop = min(end, len(lengths))
                    names.extend(batch.column(1)[first + at : first + stop].to_pylist())
                    sizes.append(lengths[at:stop])
                    ids.append(found[done : upto[stop - 1]])
                    held += upto[stop - 1] - done
                    at, done = stop, upto[stop - 1]
                    if held >= segment_ids:
                        yield row(part, kind)
                        names, ids, sizes, held, made = [], [], [], 0, made + 1
        if names:
            yield row(part, kind)

    numbered = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    return numbered.mapInArrow(
        run, f"part int, segment bigint, doc_ids array<{kind}>, n_tokens array<bigint>, payload binary"
    )


def write_ids(
    docs: DataFrame,
    path: str,
    vocabulary_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    segment_ids: int = SEGMENT_IDS,
) -> None:
    """Encode all documents and write them as a store at ``path``."""
    table = segments(docs, vocabulary_path, id_col, text_col, end_id, segment_ids)
    # Payloads do not shrink any further, and a few rows are many bytes.
    writer = table.write.option("compression", "none").option("parquet.block.size.row.check.min", "1")
    writer.option("parquet.page.size.row.check.min", "1").option("parquet.block.size.row.check.max", "4").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, segment, place, ids) of a store; ids are little-endian 32-bit integers."""
    return _decoded(spark, path, False)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, segment, place, local, n_tokens, ids_crc32) of a store: ids stay in the task.

    ``local`` is the number of ids before the document in its segment.
    """
    return _decoded(spark, path, True)


def _decoded(spark: SparkSession, path: str, digests: bool) -> DataFrame:
    store = spark.read.parquet(path).select("part", "segment", "doc_ids", "payload")
    kind = store.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = unpack(batch.column(3)[i].as_py())
                n, names = len(ids), batch.column(2)[i].values
                common = [
                    names,
                    pa.array([batch.column(0)[i].as_py()] * n, pa.int32()),
                    pa.array([batch.column(1)[i].as_py()] * n, pa.int64()),
                    pa.array(range(n), pa.int64()),
                ]
                columns = ["doc_id", "part", "segment", "place"]
                if digests:
                    sizes = np.array([len(d) for d in ids], dtype=np.int64)
                    sums = [zlib.crc32(d.tobytes()) for d in ids]
                    common += [pa.array(np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(sums, pa.int64())]
                    columns += ["local", "n_tokens", "ids_crc32"]
                else:
                    common.append(pa.array([d.tobytes() for d in ids], pa.binary()))
                    columns.append("ids")
                yield pa.RecordBatch.from_arrays(common, columns)

    tail = "local bigint, n_tokens bigint, ids_crc32 bigint" if digests else "ids binary"
    return store.mapInArrow(run, f"doc_id {kind}, part int, segment bigint, place bigint, {tail}")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a store, read back: doc_id, start, n_tokens, ids_crc32."""
    found = read_digests(spark, path)
    # A row per segment, from the store's own columns: what stands before it.
    sizes = spark.read.parquet(path).select(
        "part", "segment", F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n")
    )
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    # One row per written part: as many as files, not as documents.
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("part_start"))
    here = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("part", "segment", F.coalesce(F.sum("n").over(here), F.lit(0)).alias("segment_start")).join(
        offsets, "part"
    )
    begins = small(begins, sizes.count())
    return found.join(begins, ["part", "segment"]).select(
        "doc_id",
        (F.col("part_start") + F.col("segment_start") + F.col("local")).cast("bigint").alias("start"),
        "n_tokens",
        "ids_crc32",
    )


def store_and_read(docs: DataFrame, vocabulary_path: str, path: str | None = None, **options) -> DataFrame:
    """Write ``docs`` as a store (a new one in the work folder by default) and list what it holds."""
    spark = docs.sparkSession
    path = path or new_work_path(spark, "token-ids")
    write_ids(docs, path, vocabulary_path, **options)
    return catalogue(spark, path)

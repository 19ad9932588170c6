"""Byte-level BPE: encoding by a lazily determinised finite-state transducer, decoding by a UTF-8 state machine.

**Encoding.** Two facts about rank-ordered merging carry the transducer. A piece's last token follows from its bytes
alone, and cutting that token off leaves the encoding of the shorter piece. And a sequence of tokens is the encoding
of its bytes exactly when each two neighbours, merged on their own, stay apart. So reading one byte at a time needs
only hypotheses: a position where a token may begin, the token before it, and the node of the vocabulary's trie
reached since. A state of the transducer is the set of live hypotheses, each with its tokens not yet emitted. Tokens
that all hypotheses agree on are emitted at once; as no token is longer than the longest in the vocabulary, the
lookahead is bounded by that length. Transitions are worked out on first use and kept, which determinises only the
part of the transducer that the texts visit. A piece of any length takes time in proportion to its length.

**Decoding.** Token by token: the state is where in a UTF-8 sequence the stream stands, and each (state, token) maps
to the text it completes and the state after. Malformed bytes become U+FFFD, so any stream of ids can be decoded.

Cases: a null text is encoded as empty and gives no ids; a text of any length is encoded whole, piece by piece; rows
that repeat are encoded each; an empty table gives an empty result; the output holds the id column and its own columns,
so other columns cannot clash. Kept transitions and pieces are bounded in number: a full table of pieces is begun anew (what is
asked for again moves over), transitions that a full table lacks are worked out for the piece at hand. That costs time and changes no result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import table, worker_tables

#: Most entries of a worker's table of pieces, of transitions and of checked pairs.
MOST_PIECES, MOST_STATES, MOST_PAIRS = 600_000, 60_000, 500_000
#: Longest piece, in bytes, that the table of pieces holds.
LONGEST_KEPT = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a vocabulary file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merged(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """Encoding of a short piece by the definition: merge the pair of lowest rank, leftmost first."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """The encoder of one vocabulary.

    A state is (token emitted last or None, hypotheses), a hypothesis (tokens not yet emitted, trie node). The
    hypothesis at the trie's root, which is a state's last, holds the encoding of all that was read.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        # The trie: by node (0 is the root) and byte, the token that ends there, if any, and the node after; 0 where no token goes on.
        self.kids: list[dict[int, tuple[int | None, int]]] = [{}]
        for token, rank in ranks.items():
            node = 0
            for byte in token[:-1]:
                ended, after = self.kids[node].get(byte, (None, 0))
                if not after:
                    after = len(self.kids)
                    self.kids.append({})
                    self.kids[node][byte] = (ended, after)
                node = after
            self.kids[node][token[-1]] = (rank, self.kids[node].get(token[-1], (None, 0))[1])
        # Tokens that begin, or end, a merge of two: parts that do neither can be left out of a check.
        cuts = [(t[:i], t[i:]) for t in ranks for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.begins, self.ends = {x for x, _ in cuts}, {y for _, y in cuts}
        self.pairs: dict[tuple[int | None, int], bool] = {}
        self.edges: dict[int, tuple[bool, list, list]] = {}
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.start = self.number((None, (((), 0),)))

    def number(self, state: tuple) -> int:
        found = self.numbers.get(state)
        if found is None:
            found = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return found

    def edge_parts(self, token: int) -> tuple[bool, list, list]:
        """Whether the token is its own encoding, and the parts at its left and its right edge while it is merged.

        A part comes with the rank of the merge that ends it, the token itself with none (infinity). Merges run in
        order of rank, as no token is made of parts of higher rank; where that fails, the first value is None.
        """
        found = self.edges.get(token)
        if found is None:
            whole = self.bytes_of[token]
            parts = [whole[i : i + 1] for i in range(len(whole))]
            left, right, latest, ordered = [parts[0]], [parts[-1]], -1, True
            ends: tuple[list, list] = ([], [])
            while len(parts) > 1:
                best = min(((self.ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in self.ranks), default=None)
                if best is None:
                    break
                rank, i = best
                ordered &= rank >= latest
                latest = rank
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                for side, edge, was in ((0, parts[0], left), (1, parts[-1], right)):
                    if len(edge) != len(was[-1]):
                        was.append(edge)
                        ends[side].append(rank)
            whole_again = len(parts) == 1
            never = float("inf")
            at_left = [(y, rank) for y, rank in zip(left, [*ends[0], never]) if y in self.ends]
            at_right = [(x, rank) for x, rank in zip(right, [*ends[1], never]) if x in self.begins]
            found = (whole_again if ordered else None, at_left, at_right)
            self.edges[token] = found
        return found

    def stay_apart(self, before: int | None, token: int) -> bool:
        """Whether the two tokens, merged on their own, are their own encoding; None stands for the piece's start."""
        key = (before, token)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._apart(before, token)
        return found

    def _apart(self, before: int | None, token: int) -> bool:
        own, left, _ = self.edge_parts(token)
        if before is None and own is not None:
            return own
        own_before, _, right = self.edge_parts(before) if before is not None else (True, [], [])
        if own is None or own_before is None:
            both = [token] if before is None else [before, token]
            return merged(self.ranks, b"".join(self.bytes_of[t] for t in both)) == both
        if not (own and own_before):
            return False
        # A merge across the border happens if its rank comes before the ranks that end the two parts; of equal ranks,
        # the leftmost merge goes first.
        rank_of = self.ranks.get
        for x, x_ends in right:
            for y, y_ends in left:
                rank = rank_of(x + y)
                if rank is not None and rank < x_ends and rank <= y_ends:
                    return False
        return True

    def after(self, last: int | None, live, tail) -> list[tuple[tuple[int, ...], int]]:
        """The hypotheses after some bytes; the last of them holds the encoding so far."""
        kids, pairs = self.kids, self.pairs.get
        for byte in tail:
            found, ended = [], None
            for pending, node in live:
                next_ = kids[node].get(byte)
                if next_ is None:
                    continue
                token, node = next_
                if ended is None and token is not None:
                    before = pending[-1] if pending else last
                    apart = pairs((before, token))
                    if self.stay_apart(before, token) if apart is None else apart:
                        ended = (*pending, token)
                if node:
                    found.append((pending, node))
            if ended is None:
                raise ValueError(f"the vocabulary has no token for byte {byte}")
            found.append((ended, 0))
            live = found
        return live

    def step(self, state: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        """A transition worked out: the state after a byte, and the tokens that it emits."""
        last, live = state
        found = self.after(last, live, (byte,))
        ended = found[-1][0]
        same = 0
        shortest = min(len(p) for p, _ in found)
        while same < shortest and all(p[same] == ended[same] for p, _ in found):
            same += 1
        if not same:
            return (last, tuple(found)), ()
        return (ended[same - 1], tuple((p[same:], n) for p, n in found)), ended[:same]

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece.

        While the table has room, a new transition is kept; later on, what the table lacks is worked out for the piece
        alone, and not kept.
        """
        out: list[int] = []
        number, steps, size = self.start, self.steps, len(piece)
        for at, byte in enumerate(piece):
            found = steps[number].get(byte)
            if found is None:
                if len(self.states) >= MOST_STATES:
                    break
                state, emitted = self.step(self.states[number], byte)
                found = steps[number][byte] = (self.number(state), emitted)
            number, emitted = found
            if emitted:
                out += emitted
        else:
            return out + [*self.states[number][1][-1][0]]
        last, live = self.states[number]
        if size <= LONGEST_KEPT:
            return out + [*self.after(last, live, piece[at:])[-1][0]]
        for byte in piece[at:]:  # emits as it goes, so that a long piece costs in proportion to its length
            (last, live), emitted = self.step((last, live), byte)
            out += emitted
        return out + [*live[-1][0]]


class Pieces(dict):
    """From a piece of text to its ids in decimal, joined by commas."""

    def __init__(self, encode, key_prefix: str = "", split=None, pieces: dict | None = None):
        super().__init__()
        self.encode, self.key_prefix, self.split, self.pieces = encode, key_prefix, split, pieces
        #: The entries of before the table was last full; those asked for again move over.
        self.older: dict[str, str] = {}

    def __missing__(self, key: str) -> str:
        found = self.older.get(key)
        if found is not None:
            self[key] = found
            return found
        piece = self.key_prefix + key
        # Letters alone are one piece. Of several, those that begin with the prefix are kept here, others with the pieces.
        parts = [piece] if self.split is None or key.isalpha() else self.split(piece)
        if len(parts) == 1:
            found = ",".join(map(str, self.encode(piece.encode())))
        else:
            size = len(self.key_prefix)
            found = ",".join([self[p[size:]] if p.startswith(self.key_prefix) else self.pieces[p] for p in parts])
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= MOST_PIECES // 2:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class StreamDecoder:
    """Ids to text as they come. The state is the bytes of a UTF-8 sequence that has begun and not ended."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        #: By state, from an id in decimal to the text that it completes and the state after.
        self.steps: dict[bytes, dict[str, tuple[str, bytes]]] = {b"": {}}

    def step(self, state: bytes, token: str) -> tuple[str, bytes]:
        out, begun = [], state
        for byte in self.bytes_of[int(token)]:
            text, begun = advance(begun, byte)
            out.append(text)
        found = "".join(out), begun
        self.steps.setdefault(state, {})[token] = found
        self.steps.setdefault(begun, {})
        return found

    def decode(self, tokens: list[str]) -> Iterator[str]:
        """Text piece by piece; what is left of a sequence that never ends comes last, as U+FFFD."""
        steps, state = self.steps, b""
        here = steps[state]
        for token in tokens:
            found = here.get(token)
            if found is None:
                found = self.step(state, token)
            text, after = found
            if after != state:
                state, here = after, steps[after]
            if text:
                yield text
        if state:
            yield "\ufffd"

    def whole(self, tokens: list[str]) -> str:
        """The text of a finished stream. Runs of tokens that end between characters go through one table at once."""
        try:
            return "".join(map(self.closed.__getitem__, tokens))
        except KeyError:
            return "".join(self.decode(tokens))

    @cached_property
    def closed(self) -> dict[str, str]:
        """The transitions from and to the state between characters."""
        found = ((str(i), self.step(b"", str(i))) for i in self.bytes_of)
        return {token: text for token, (text, after) in found if not after}


#: By first byte of a sequence of several: how many bytes it has, and the bounds of the second byte.
LEADS = (
    {b: (2, 0x80, 0xBF) for b in range(0xC2, 0xE0)}
    | {b: (3, 0x80, 0xBF) for b in range(0xE1, 0xF0)}
    | {0xE0: (3, 0xA0, 0xBF), 0xED: (3, 0x80, 0x9F)}
    | {b: (4, 0x80, 0xBF) for b in range(0xF1, 0xF4)}
    | {0xF0: (4, 0x90, 0xBF), 0xF4: (4, 0x80, 0x8F)}
)


def advance(begun: bytes, byte: int) -> tuple[str, bytes]:
    """One step of the UTF-8 machine: the text that a byte completes, and the sequence that stays open."""
    if not begun:
        if byte < 0x80:
            return chr(byte), b""
        return ("", bytes([byte])) if byte in LEADS else ("�", b"")
    size, low, high = LEADS[begun[0]]
    if not ((low <= byte <= high) if len(begun) == 1 else (0x80 <= byte <= 0xBF)):
        text, after = advance(b"", byte)
        return "�" + text, after
    begun += bytes([byte])
    return (begun.decode(), b"") if len(begun) == size else ("", begun)


class Encoder:
    """A worker's tables for one vocabulary and pattern."""

    def __init__(self, path: str, pattern: str):
        self.transducer = Transducer(read_ranks(path))
        self.split = regex.compile(pattern)
        self.pieces = Pieces(self.transducer.encode)
        #: From what stands between two spaces to the ids of it and the space before it.
        self.words = Pieces(self.transducer.encode, " ", self.split.findall, self.pieces) if pattern in SPACED else None
        self.decoder = StreamDecoder(self.transducer.bytes_of)

    def joined(self, text: str) -> str:
        """The ids of a text in decimal, joined by commas."""
        if self.words is not None and not UNEVEN(text):
            first, *rest = text.split(" ")
            found = ",".join(map(self.words.__getitem__, rest))
            head = ",".join(map(self.pieces.__getitem__, self.split.findall(first)))
            return f"{head},{found}" if head and found else head or found
        return ",".join(map(self.pieces.__getitem__, self.split.findall(text)))


#: Patterns that match a space that another character follows only together with what follows, and that look no further
#: ahead than to the next character: a text may then be cut before each such space and the parts matched on their own.
SPACED = {r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""}
#: Whether a text has a space that white space or the end follows; such a text is matched as a whole.
UNEVEN = re.compile(r" (?:\s|\Z)").search


def encoder(path: str, pattern: str) -> Encoder:
    return worker_tables(("bpe", path, pattern), lambda: Encoder(path, pattern))


def encode_text(text: str | None, path: str, pattern: str) -> list[int]:
    """The ids of one text; the plain interface for use outside a DataFrame."""
    found = encoder(path, pattern).joined(text or "")
    return list(map(int, found.split(","))) if found else []


def decode_ids(ids: list[int], path: str, pattern: str) -> str:
    return encoder(path, pattern).decoder.whole([str(i) for i in ids])


def _kept_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int): the encoding of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encode_text(t.as_py(), path, pattern) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = _kept_columns(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the text of its ids in the column ``decoded``; null ids give null."""

    @F.pandas_udf("string")
    def text_of_ids(ids):
        return ids.map(lambda x: None if x is None else decode_ids(x, path, pattern))

    return encoded.withColumn("decoded", text_of_ids(ids_col))


def round_trips(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, and its ids decoded again.

    Without a path, each worker finds the file of :func:`vocabulary` where it runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern) if path else encoder(*vocabulary())
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for value in batch["text"]:
                ids = own.joined(value.as_py() or "")
                tokens = ids.split(",") if ids else []
                counts.append(len(tokens))
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(own.decoder.whole(tokens).encode()).hexdigest())
            columns = [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = _kept_columns(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the vocabulary that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"))

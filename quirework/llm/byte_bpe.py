"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

Encoding.  A text is split by the pattern; each match is encoded by itself.  Let e(i) be the
last token of the encoding of a piece's first i bytes.  A piece's encoding is the chain n,
n-|e(n)|, ...; e(n) is the one suffix token whose pair with the token before it is left as
it is by the merges.  A state of the transducer is the bytes read since the last boundary
that no continuation can move: every byte position from which a vocabulary entry could still
grow across the end of the input must lead back through that boundary.  On a byte, the tokens
before the new common boundary are emitted and the rest becomes the next state, so the
lookahead is bounded by the vocabulary.  States and arcs are made when first met and dropped
when there are too many, as in lazy automata for regular expressions.  Whole segments (white
space and the non-space run after it, to which the pattern's matches are confined) are memoised
as longer arcs from the start state to itself.

Decoding.  ``Utf8Decoder`` joins the bytes of a run of tokens at a time; a UTF-8 state machine over
their last bytes says what is still to be completed by the next run, the rest is handed out.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .frames import per_document, resident

#: White space as the pattern's \s has it (the Unicode property White_Space).
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SEGMENT = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
#: Bounds of what a Python worker keeps: some hundred bytes each.
MAX_STATES = 200_000
MAX_PAIRS = 40_000
MAX_SEGMENTS = 200_000
#: Tokens decoded at a time.
RUN = 1024
NEVER = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class State(dict):
    """The arcs made so far: byte to (next state, settled tokens); the bytes held, by position the length of the last token there, and the places from which a token may still grow."""

    __slots__ = ("held", "last", "open", "machine")

    def __init__(self, machine: Transducer, held: bytes, last: bytes, open_: tuple[int, ...]):
        self.machine, self.held, self.last, self.open = machine, held, last, open_

    def __missing__(self, byte: int) -> tuple[State, tuple[int, ...]]:
        step = self[byte] = self.machine.arc(self, byte)
        return step


class Transducer:
    """Pieces of bytes to token ids; it keeps ``share`` of MAX_STATES."""

    def __init__(self, ranks: dict[bytes, int], share: float = 1.0):
        self.most = int(MAX_STATES * share)
        if max(map(len, ranks)) > 255:
            raise ValueError("tokens of more than 255 bytes")  # a state keeps lengths as bytes
        self.ranks = ranks
        self.growing = {t[:i] for t in ranks for i in range(1, len(t))}
        self.halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.start = State(self, b"", b"\0", ())
        self.places: dict[tuple[int, ...], tuple[int, ...]] = {}
        self.states: dict[bytes, State] = {b"": self.start}

    def halved(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts that the merges of the token's own bytes join last; None if they don't end in the token."""
        if token not in self.halves:
            rank = self.ranks.get
            parts, before = [token[i : i + 1] for i in range(len(token))], []
            costs = [rank(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            while costs and (low := min(costs)) != NEVER:  # always the lowest rank, leftmost first
                at, before = costs.index(low), list(parts)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                del costs[at]
                if at:
                    costs[at - 1] = rank(parts[at - 1] + parts[at], NEVER)
                if at < len(costs):
                    costs[at] = rank(parts[at] + parts[at + 1], NEVER)
            self.halves[token] = (before[0], before[1]) if len(parts) == 1 else None
        return self.halves[token]

    def made(self, token: bytes) -> bool:
        return len(token) == 1 or self.halved(token) is not None

    def stable(self, left: bytes, right: bytes) -> bool:
        """Whether the merges of left + right give these two tokens (or the one, if left is empty).

        Backwards in time from the two: of the parts that meet at the seam the one made later is
        undone.  A merge of the two parts comes to pass if its rank is below that of what becomes
        of the left one, and not above that of the right one (leftmost first).
        """
        if not left:
            return self.made(right)
        known = self.pairs.get((left, right))
        if known is None:
            ranks, x, y, end_x, end_y = self.ranks, left, right, NEVER, NEVER
            known = self.made(left) and self.made(right)
            while known:
                rank = ranks.get(x + y, NEVER)
                if rank < end_x and rank <= end_y:
                    known = False
                elif len(x) == len(y) == 1:
                    break
                elif len(x) == 1 or len(y) > 1 and ranks[y] >= ranks[x]:
                    end_y, y = ranks[y], self.halved(y)[0]
                else:
                    end_x, x = ranks[x], self.halved(x)[1]
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def arc(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        """Determinise one transition: the next state and the tokens that are settled by it."""
        held, last, ranks = state.held + bytes((byte,)), state.last, self.ranks
        n, size, open_ = len(held), 0, []
        for at in (*state.open, len(state.held)):  # the longest token first
            grown = held[at:]
            if not size and grown in ranks and self.stable(held[at - last[at] : at], grown):
                size = n - at
            if grown in self.growing:
                open_.append(at)
        last += bytes((size,))
        ends = {*open_, n}
        while len(ends) > 1:  # the nearest boundary on all chains
            cut = max(ends)
            ends.remove(cut)
            ends.add(cut - last[cut])
        cut = ends.pop()
        out, at = [], cut
        while at:
            out.append(ranks[held[at - last[at] : at]])
            at -= last[at]
        rest = held[cut:]
        if (to := self.states.get(rest)) is None:
            if len(self.states) > self.most:
                self.reset()
            grows = tuple([at - cut for at in open_])
            to = self.states[rest] = State(self, rest, b"\0" + last[cut + 1 :], self.places.setdefault(grows, grows))
        return to, tuple(reversed(out))

    def encode(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        state, ids = self.start, []
        for byte in piece:
            state, out = state[byte]
            if out:
                ids += out
        held, last = state.held, state.last
        tail, at = [], len(held)
        while at:
            tail.append(self.ranks[held[at - last[at] : at]])
            at -= last[at]
        return ids + tail[::-1]


class Segments(dict):
    """Memo from a segment to the ids of its pattern matches, in two generations: what was not asked for since the last turn goes."""

    def __init__(self, machine: Transducer, pattern: str, share: float = 1.0):
        import regex

        self.most = int(MAX_SEGMENTS * share)
        self.machine = machine
        self.before: dict[str, tuple[int, ...]] = {}
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACES}").replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]"))

    def __missing__(self, segment: str) -> tuple[int, ...]:
        ids = self.before.get(segment)
        if ids is None:
            encode = self.machine.encode
            ids = tuple([i for piece in self.pattern.findall(segment) for i in encode(piece.encode("utf-8", "replace"))])
        if len(segment) < 200:
            if len(self) >= self.most:
                self.before = dict(self)
                self.clear()
            self[segment] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for found in map(self.__getitem__, SEGMENT.findall(text)):
            ids += found
        return ids


def utf8_steps() -> list[list[int]]:
    """next[state][byte]: 0 between characters, -1 where the bytes are no UTF-8, else what must follow.

    States 1 to 3: so many continuation bytes; 4 to 7: the byte after E0, ED, F0, F4.
    """
    steps = [[-1] * 256 for _ in range(8)]
    steps[0][:128] = [0] * 128
    for lead, to in ((range(0xC2, 0xE0), 1), (range(0xE1, 0xF0), 2), ([0xE0], 4), ([0xED], 5), (range(0xF1, 0xF4), 3), ([0xF0], 6), ([0xF4], 7)):
        for b in lead:
            steps[0][b] = to
    for state, bytes_, to in ((1, range(0x80, 0xC0), 0), (2, range(0x80, 0xC0), 1), (3, range(0x80, 0xC0), 2), (4, range(0xA0, 0xC0), 1), (5, range(0x80, 0xA0), 1), (6, range(0x90, 0xC0), 2), (7, range(0x80, 0x90), 2)):
        for b in bytes_:
            steps[state][b] = to
    return steps


class Utf8Decoder:
    """Token ids to bytes and, run by run, to text; bytes that are no UTF-8 become U+FFFD in the text."""

    def __init__(self, ranks: dict[bytes, int]):
        self.steps = utf8_steps()
        self.bytes_of = {i: t for t, i in ranks.items()}

    def begun(self, data: bytes) -> int:
        """How many of the last bytes are the beginning of a character that is still to end."""
        for keep in range(min(3, len(data)), 0, -1):
            state = 0
            for b in data[len(data) - keep :]:
                state = self.steps[state][b]
                if state < 0:
                    break
            if state > 0 and data[-keep] >= 0xC2:
                return keep
        return 0

    def runs(self, ids: list[int], run: int = RUN) -> Iterator[bytes]:
        """The ids' bytes, as soon as the characters in them are complete: looked at after each ``run`` tokens."""
        held = b""
        for at in range(0, len(ids), run):
            held += b"".join(map(self.bytes_of.__getitem__, ids[at : at + run]))
            cut = len(held) - self.begun(held)
            if cut:
                yield held[:cut]
                held = held[cut:]
        if held:
            yield held

    def stream(self, ids: list[int], run: int = 1) -> Iterator[str]:
        """Text in pieces of whole characters."""
        return (piece.decode("utf-8", "replace") for piece in self.runs(ids, run))

    def decode(self, ids: list[int]) -> tuple[bytes, bool]:
        """All bytes, and whether they are whole UTF-8."""
        pieces, valid = list(self.runs(ids)), True
        for piece in pieces:
            try:
                piece.decode()
            except UnicodeDecodeError:
                valid = False
        return b"".join(pieces), valid


def codec(path: str, pattern: str, share: float = 1.0) -> tuple[Segments, Utf8Decoder, list[str]]:
    """Encoder, decoder and the ids' decimal digits: made once a Python worker, kept until it works for another operator."""

    def make():
        ranks = load_ranks(path)
        return Segments(Transducer(ranks, share), pattern, share), Utf8Decoder(ranks), list(map(str, range(max(ranks.values()) + 1)))

    return resident(f"byte_bpe {path} {pattern} {share}", make)


def encode_documents(docs: DataFrame, path: str, pattern: str, share: float = 1.0) -> DataFrame:
    """Encode every text, decode the ids again.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256
    (of the bytes that the streaming decoder gives), utf8_valid.  A null text counts as empty: no
    ids.  Repeated rows stay, equal texts get equal values; other columns are ignored, whatever
    their names.  A lone surrogate, which no UTF-8 input holds, counts as "?".  A long text takes
    memory in proportion to its length.  An empty table gives no rows.  ``share`` scales what a worker
    remembers (about 200 MB at 1): less memory for more time, with the same results.
    """

    def start():
        segments, decoder, digits = codec(path, pattern, share)
        sha = hashlib.sha256

        def one(doc_id, text):
            ids = segments.encode(text or "")
            decoded, valid = decoder.decode(ids)
            return doc_id, len(ids), sha(",".join([digits[i] for i in ids]).encode()).hexdigest(), sha(decoded).hexdigest(), valid

        return one

    return per_document(docs, ["doc_id", "text"], start, "doc_id long,n_tokens long,ids_sha256 string,decoded_sha256 string,utf8_valid boolean", f"byte_bpe {path} {pattern} {share}")

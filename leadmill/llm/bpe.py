"""Byte-level BPE by a lazily determinised finite-state transducer.

Let T(i) be the last token of the encoding of a piece's first i bytes. T(i) is the one token
ending at byte i that stands beside T(i - its length) without a merge across their border, so
it can be found byte by byte, without looking ahead. A token that starts at j can only come up
later while the bytes from j on are the beginning of some token. Positions for which that
holds are live. Once all live positions lead back, token by token, through one position, all
tokens before it are certain and are emitted; lookahead is thus bounded by the longest token.

A state of the transducer is the chain of last tokens from the last certain position on. States
and their transitions are made when they are needed a second time, and are forgotten together when
their number passes a bound, so memory does not grow with the corpus. At a transition that is
needed for the first time, the rest of a short piece runs over live positions alone: most ends of
rare words never come again.

Decoding joins the tokens' bytes and feeds them block by block to an incremental UTF-8
decoder, which keeps the bytes of an unfinished character until the next block.
"""

import base64
import codecs
import gc
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

#: States, checked borders and encoded fragments that one Python worker keeps.
MAX_STATES = 200_000
MAX_BORDERS = 500_000
MAX_FRAGMENTS = 300_000
#: Tokens that are decoded at once.
DECODE_BLOCK = 4096
#: Longest fragment whose encoding is remembered.
LONG_FRAGMENT = 64

#: A space with white space beside it: only there can a match of the pattern cross a space.
_WIDE_SPACE = re.compile(r"^\s|\s$|\s | \s")


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of a tiktoken file and the pattern that splits a text before the merges.

    `cache` scales what a Python worker remembers: less where other stages use its memory.
    """

    path: str
    pattern: str
    cache: float = 1.0


class _State:
    __slots__ = ("next", "chain", "live", "tail")

    def __init__(self, chain: tuple, live: list[tuple[int, int]]):
        # chain[k] is the last token at byte k since the last certain position, where it is
        # chain[0], or None if no later token can start there. live: live positions, and the
        # places in the trie that the bytes from there on lead to.
        # next has None for a byte that was met once.
        self.next: dict[int, tuple["_State", tuple] | None] = {}
        self.chain, self.live, self.tail = chain, live, None


class Transducer:
    def __init__(self, ranks: dict[bytes, int], cache: float = 1.0):
        self.max_states, self.max_borders = int(MAX_STATES * cache), int(MAX_BORDERS * cache)
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.borders: dict[int, bool] = {}
        # Trie of the tokens: (place << 8 | byte) -> place, and the token there or None. Places
        # that no token goes on from are negative.
        self.child: dict[int, tuple[int, int | None]] = {}
        inner = {t[:n] for t in ranks for n in range(1, len(t))} | {b""}
        place = {p: k for k, p in enumerate(sorted(inner, key=len))}
        for k, t in enumerate(ranks):
            place.setdefault(t, -1 - k)
        for t, p in place.items():
            if t:
                self.child[place[t[:-1]] << 8 | t[-1]] = p, ranks.get(t)
        # Whether merges can give a token, as far as that was asked.
        self.made: dict[int, bool] = {}
        self.states: dict[tuple, _State] = {}
        self.forget()

    def forget(self) -> None:
        """Start anew. States refer to each other; without that, they are freed at once."""
        for state in self.states.values():
            state.next.clear()
        self.start = _State((None,), [(0, 0)])
        self.states = {self.start.chain: self.start}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives the token; None for a byte or an unreachable token."""
        if token not in self.split:
            parts = [self.bytes_of[token][i : i + 1] for i in range(len(self.bytes_of[token]))]
            while len(parts) > 2:
                pairs = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:])]
                best = min((r for r in pairs if r is not None), default=None)
                if best is None:
                    break
                k = pairs.index(best)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self.split[token] = tuple(self.ranks[p] for p in parts) if len(parts) == 2 else None
        return self.split[token]

    def reached(self, token: int) -> bool:
        """Whether merges can give the token."""
        good = self.made.get(token)
        if good is None:
            good = self.made[token] = self.length[token] == 1 or self.halves(token) is not None
        return good

    def apart(self, left: int, right: int) -> bool:
        """Whether the two tokens stay two tokens beside each other, and merges give the right one.

        Going back in time, the merges next to the border are undone, the latest first. Each
        pair met at the border must not have merged before the merges that replaced it: at
        equal ranks, the pair further left merges first.
        """
        key = left << 32 | right
        known = self.borders.get(key)
        if known is not None:
            return known
        ranks, bytes_of = self.ranks, self.bytes_of
        left_end = right_end = len(ranks)
        good = self.reached(right)
        while good:
            r = ranks.get(bytes_of[left] + bytes_of[right])
            if r is not None and r < left_end and r <= right_end:
                good = False
                break
            a = left if len(bytes_of[left]) > 1 else -1
            b = right if len(bytes_of[right]) > 1 else -1
            if a == b == -1:
                break
            if a > b:
                left_end, left = a, self.halves(a)[1]
            else:
                right_end, right = b, self.halves(b)[0]
        if len(self.borders) >= self.max_borders:
            self.borders.clear()
        self.borders[key] = good
        return good

    def step(self, state: _State, byte: int) -> tuple[_State, tuple]:
        """The state after one more byte, and the tokens that are certain with it."""
        chain, length = state.chain, self.length
        live = []
        token = None
        child, borders = self.child.get, self.borders.get
        for start, place in state.live:
            at = child(place << 8 | byte)
            if at is None:
                continue
            place, t = at
            if place >= 0:
                live.append((start, place))
            if token is None and t is not None:
                last = chain[start]
                if last is None:
                    good = self.reached(t)
                else:
                    good = borders(last << 32 | t)
                    if good is None:
                        good = self.apart(last, t)
                if good:
                    token = t
        if token is None:
            raise ValueError("the ranks lack a single byte or are no merge ranks")
        chain = chain + (token,)
        end = len(chain) - 1
        # Walk all live positions back until one position is left.
        sure, at = end, [k for k, _ in live]
        while at:
            if at[-1] == sure:
                at.pop()
            elif at[-1] > sure:
                at[-1] -= length[chain[at[-1]]]
                at.sort()
            else:
                sure -= length[chain[sure]]
        out, k = [], sure
        while k > 0:
            out.append(chain[k])
            k -= length[chain[k]]
        out.reverse()
        live.append((end, 0))
        chain = chain[sure:]
        if live[0][0] != sure:
            chain = (None,) + chain[1:]
        if len(self.states) >= self.max_states:
            self.forget()
        nxt = self.states.get(chain)
        if nxt is None:
            nxt = self.states[chain] = _State(chain, [(k - sure, p) for k, p in live])
        found = state.next[byte] = (nxt, tuple(out))
        return found

    def rest(self, state: _State) -> tuple:
        """The tokens of a state at the end of a piece."""
        if state.tail is None:
            out, k = [], len(state.chain) - 1
            while k > 0:
                out.append(state.chain[k])
                k -= self.length[state.chain[k]]
            state.tail = tuple(reversed(out))
        return state.tail

    def run(self, state: _State, piece: bytes) -> list[int]:
        """The tokens from a state to the end of a piece, without making states."""
        chain, live = list(state.chain), state.live
        length, child, borders = self.length, self.child.get, self.borders.get
        for byte in piece:
            still, token = [], None
            for start, place in live:
                at = child(place << 8 | byte)
                if at is None:
                    continue
                place, t = at
                if place >= 0:
                    still.append((start, place))
                if token is None and t is not None:
                    last = chain[start]
                    if last is None:
                        good = self.reached(t)
                    else:
                        good = borders(last << 32 | t)
                        if good is None:
                            good = self.apart(last, t)
                    if good:
                        token = t
            if token is None:
                raise ValueError("the ranks lack a single byte or are no merge ranks")
            still.append((len(chain), 0))
            chain.append(token)
            live = still
        out, k = [], len(chain) - 1
        while k > 0:
            out.append(chain[k])
            k -= length[chain[k]]
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        state, out = self.start, []
        for k, byte in enumerate(piece):
            found = state.next.get(byte)
            if found is None:
                if byte not in state.next and len(piece) - k <= LONG_FRAGMENT:
                    state.next[byte] = None
                    out.extend(self.run(state, piece[k:]))
                    return out
                found = self.step(state, byte)
            state = found[0]
            if found[1]:
                out.extend(found[1])
        out.extend(self.rest(state))
        return out


#: Ids of a run of text: decimals, each with a comma behind it, and unsigned 32-bit integers.
Ids = tuple[str, bytes]


class _Recent:
    """A dictionary that forgets what was not asked for while half its size was added."""

    def __init__(self, size: int):
        self.half, self.young, self.old = max(1, size // 2), {}, {}

    def put(self, key: str, value: "Ids") -> None:
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        self.young[key] = value

    def get(self, key: str) -> "Ids | None":
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        with open(vocabulary.path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.fst = Transducer(ranks, vocabulary.cache)
        self.find = regex.compile(vocabulary.pattern).finditer
        most = int(MAX_FRAGMENTS * vocabulary.cache)
        self.fragments, self.pieces = _Recent(most), _Recent(most)
        # The bytes of all tokens in one array, and where each token begins and how long it is.
        tokens = [self.fst.bytes_of.get(r, b"") for r in range(max(self.fst.bytes_of) + 1)]
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def _piece(self, piece: str) -> Ids:
        """Ids of a match of the pattern."""
        done = self.pieces.get(piece)
        if done is None:
            ids = self.fst.encode(piece.encode())
            done = "".join([f"{i}," for i in ids]), array("I", ids).tobytes()
            if len(piece) <= LONG_FRAGMENT:
                self.pieces.put(piece, done)
        return done

    def _fragment(self, text: str) -> Ids:
        """Ids of a fragment, which is one match or several."""
        if text[1:].isalpha() and text[0] == " ":
            return self._piece(text)
        known = self.fragments.get(text)
        if known is not None:
            return known
        if text[-1] in ",.;:!?" and text[1:-1].isalpha() and text[0] == " ":
            parts = [self._piece(text[:-1]), self._piece(text[-1])]
        else:
            parts = [self._piece(m.group()) for m in self.find(text)]
        done = "".join([d for d, _ in parts]), b"".join([i for _, i in parts])
        if len(text) <= LONG_FRAGMENT:
            self.fragments.put(text, done)
        return done

    def encode(self, text: str) -> Iterator[Ids]:
        """Ids of a text in blocks.

        A match of the pattern takes a space only as its first byte, unless white space stands
        beside the space. So texts without such spaces split at their spaces into fragments
        that often recur.
        """
        if not text:
            return
        if _WIDE_SPACE.search(text):
            fragments = (m.group() for m in self.find(text))
        else:
            first, *others = text.split(" ")
            fragments = [first, *[" " + x for x in others]]
        # Dictionaries change when one is full, so they are looked up anew for each block.
        make = self._fragment
        block = []
        fast, fast_piece = self.fragments.young, self.pieces.young
        for f in fragments:
            block.append(fast_piece.get(f) or fast.get(f) or make(f))
            if len(block) == DECODE_BLOCK:
                yield _join(block)
                block = []
                fast, fast_piece = self.fragments.young, self.pieces.young
        if block:
            yield _join(block)

    def decode(self, blocks: Iterable[bytes]) -> Iterator[str]:
        """Text of 32-bit ids, block by block; bytes that are no UTF-8 become U+FFFD."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for block in blocks:
            ids = np.frombuffer(block, np.uint32)
            n = self.lengths[ids]
            ends = np.cumsum(n)
            # Byte k of the block is byte k - (end - length) of its token.
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begins[ids] - ends + n, n)
            yield decoder.decode(self.bytes[at].tobytes())
        yield decoder.decode(b"", True)


def _join(block: list[Ids]) -> Ids:
    decimals, ids = zip(*block)
    return "".join(decimals), b"".join(ids)


@contextmanager
def no_collection():
    """Without searches for cyclic garbage, which would go through all states again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _without_collection(work):
    """The same generator, run without searches for cyclic garbage."""

    def run(batches):
        with no_collection():
            yield from work(batches)

    return run


@cache
def codec(vocabulary: Vocabulary) -> Codec:
    """One per Python worker."""
    return Codec(vocabulary)


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of docs: its id, n_tokens and tokens (array of ids).

    A null or empty text has no tokens. Repeated rows give repeated rows; other columns are
    not carried.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(vocabulary)
        for pdf in batches:
            ids = [
                np.frombuffer(b"".join(block for _, block in c.encode(t or "")), np.uint32).tolist()
                for t in pdf["text"]
            ]
            yield pd.DataFrame({"id": pdf["id"], "n_tokens": [len(i) for i in ids], "tokens": ids})

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(
        _without_collection(work), f"id {kind}, n_tokens long, tokens array<int>"
    )
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: Vocabulary, id_col="doc_id") -> DataFrame:
    """The texts of rows as encode() gives them; null tokens give a null text."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(vocabulary)
        for pdf in batches:
            texts = [
                None
                if t is None
                else "".join(
                    c.decode(
                        np.asarray(t[k : k + DECODE_BLOCK], np.uint32).tobytes()
                        for k in range(0, len(t), DECODE_BLOCK)
                    )
                )
                for t in pdf["tokens"]
            ]
            yield pd.DataFrame({"id": pdf["id"], "text": pd.Series(texts, dtype=object)})

    kind = encoded.schema[id_col].dataType.simpleString()
    out = encoded.select(F.col(id_col).alias("id"), "tokens").mapInPandas(
        _without_collection(work), f"id {kind}, text string"
    )
    return out.withColumnRenamed("id", id_col)


def round_trip(
    docs: DataFrame, vocabulary: Vocabulary, id_col="doc_id", text_col="text"
) -> DataFrame:
    """Encode and decode each text as a stream; digests of both instead of the ids.

    n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the
    decoded bytes). Null and empty texts have 0 tokens and the digests of the empty string.
    Neither the ids nor the decoded text of a document are ever held as a whole.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(vocabulary)
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                ids, back, n = hashlib.sha256(), hashlib.sha256(), 0

                def blocks():
                    nonlocal n
                    for decimals, block in c.encode(text or ""):
                        # The comma behind a block's last id waits for the next block.
                        ids.update(("," + decimals[:-1] if n else decimals[:-1]).encode())
                        n += len(block) // 4
                        yield block

                for piece in c.decode(blocks()):
                    back.update(piece.encode())
                rows.append((n, ids.hexdigest(), back.hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "id", pdf["id"].to_numpy())
            yield out

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(
        _without_collection(work), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
    return out.withColumnRenamed("id", id_col)

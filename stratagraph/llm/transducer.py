"""Byte-level BPE as a lazily determinised transducer, and its streaming inverse.

Merges are compiled into one relation, "token b may follow token a": it holds exactly if merging the
bytes of a and b gives [a, b] again. A sequence of tokens is the merge result of its bytes exactly if
every neighbouring pair is in this relation, so for every prefix of a text the last token of its
encoding is the one vocabulary entry that ends there and may follow the last token of the rest. The
automaton reads bytes; its state is the set of places a later token may still begin at, each with its
position in the vocabulary's trie and the tokens not yet emitted before it. Tokens common to all of
them are emitted, which happens after a lookahead of at most one longest token. States and
transitions are built when first met and kept up to a bound.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator

import regex

#: The split pattern of the public vocabulary and the folder of its files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FOLDER = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: Stands for "no token before" at the start of a word.
START = -1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank of a rank file (base64 and number per line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


class Transducer:
    """Encodes byte strings by a rank table in one pass over the bytes."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 200_000, max_words: int = 300_000):
        self.ranks, self.max_states, self.max_words = ranks, max_states, max_words
        self.bytes_of = {i: t for t, i in ranks.items()}
        # Trie as lists: a node's children by byte, and the token that ends there.
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int | None] = [None]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                below = self.children[node].get(byte)
                if below is None:
                    below = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token_at.append(None)
                node = below
            self.token_at[node] = rank
        self.follows: dict[tuple[int, int], bool] = {}
        self._forget()
        self.words: dict[str, tuple[int, ...]] = {}

    def merge(self, text: bytes) -> list[int]:
        """Merges of a short byte string by rank, pair by pair: the definition that the automaton is compiled from."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = min(((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, first: int, second: int) -> bool:
        known = self.follows.get((first, second))
        if known is None:
            if len(self.follows) > 4 * self.max_states:
                self.follows.clear()
            known = self.follows[first, second] = self.merge(self.bytes_of[first] + self.bytes_of[second]) == [first, second]
        return known

    def _forget(self) -> None:
        self.states: dict[tuple, int] = {((0, (START,)),): 0}
        self.keys: list[tuple] = [((0, (START,)),)]
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def _state(self, key: tuple) -> int:
        number = self.states.get(key)
        if number is None:
            number = self.states[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
        return number

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The state after ``byte`` and the tokens emitted with it.

        A place is (trie node, pending tokens); the first pending token was emitted already (START
        stands for none) and only decides what may follow.
        """
        alive, ended = [], None
        for node, pending in self.keys[state]:
            below = self.children[node].get(byte)
            if below is None:
                continue
            alive.append((below, pending))
            token = self.token_at[below]
            if ended is None and token is not None and (pending[-1] == START or self.may_follow(pending[-1], token)):
                ended = (*pending, token)
        if ended is None:
            raise ValueError("the vocabulary has no token for a byte")
        alive.append((0, ended))
        # All places share a beginning of pending tokens; it can't change any more.
        shared = min(len(p) for _, p in alive)
        for i in range(shared):
            if any(p[i] != ended[i] for _, p in alive):
                shared = i
                break
        move = self._state(tuple((n, p[shared - 1 :]) for n, p in alive)), ended[1:shared]
        self.moves[state][byte] = move
        return move

    def encode_word(self, word: bytes) -> list[int]:
        """Tokens of one pretoken."""
        if len(self.keys) > self.max_states:
            self._forget()
        out: list[int] = []
        state, moves = 0, self.moves
        for byte in word:
            step = moves[state].get(byte)
            if step is None:
                step = self._move(state, byte)
            state, fresh = step
            if fresh:
                out += fresh
        # The newest place stands behind the whole word; its pending tokens end the encoding.
        out += self.keys[state][-1][1][1:]
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without special tokens; lone surrogates become U+FFFD."""
        words, out = self.words, []
        for word in _split(text):
            ids = words.get(word)
            if ids is None:
                if len(words) >= self.max_words:
                    words.clear()
                ids = tuple(self.encode_word(_utf8(word)))
                if len(word) <= 64:
                    words[word] = ids
            out += ids
        return out


def _utf8(word: str) -> bytes:
    try:
        return word.encode("utf-8")
    except UnicodeEncodeError:
        return word.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode("utf-8")


_split = regex.compile(SPLIT).findall


class Utf8Stream:
    """Incremental UTF-8: bytes in any portions to text; broken sequences become U+FFFD when they are certain."""

    def __init__(self):
        self.need, self.value, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        for byte in data:
            if self.need:
                if self.low <= byte <= self.high:
                    self.value, self.need, self.low, self.high = self.value << 6 | byte & 0x3F, self.need - 1, 0x80, 0xBF
                    if not self.need:
                        out.append(chr(self.value))
                    continue
                out.append("�")
                self.need, self.low, self.high = 0, 0x80, 0xBF
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xDF:
                self.need, self.value = 1, byte & 0x1F
            elif 0xE0 <= byte <= 0xEF:
                self.need, self.value = 2, byte & 0x0F
                self.low, self.high = (0xA0 if byte == 0xE0 else 0x80), (0x9F if byte == 0xED else 0xBF)
            elif 0xF0 <= byte <= 0xF4:
                self.need, self.value = 3, byte & 0x07
                self.low, self.high = (0x90 if byte == 0xF0 else 0x80), (0x8F if byte == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        """What an unfinished sequence becomes at the end."""
        cut, self.need = self.need, 0
        return "�" if cut else ""


def decode_stream(ids: Iterable[int], bytes_of: dict[int, bytes]) -> Iterator[str]:
    """Text portions of a stream of ids; a character cut by a token border comes out when it is complete."""
    stream = Utf8Stream()
    for i in ids:
        if text := stream.feed(bytes_of[i]):
            yield text
    if text := stream.end():
        yield text


_LOADED: dict[str, Transducer] = {}


def load(folder: str = FOLDER, name: str = NAME) -> Transducer:
    """The transducer of a vocabulary, one per Python worker process."""
    path = os.path.join(folder, f"{name}.tiktoken")
    if path not in _LOADED:
        _LOADED[path] = Transducer(read_ranks(path))
    return _LOADED[path]

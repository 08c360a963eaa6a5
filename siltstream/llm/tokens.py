"""Public tokenizers in tasks: each distinct word is tokenised once by the library, its ids are kept in a bounded memo."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Sequence
from functools import lru_cache
from pathlib import Path
from typing import Any

import numpy as np

#: Keys kept by a memo before the older half is dropped, and the longest key that is kept at all.
MEMO, LONG = 150_000, 64
#: The same for single words, which are fewer and smaller.
WORDS = 800_000


class Memo:
    """Values of keys seen before, in two generations: frequent keys stay, memory is bounded by ``most``."""

    def __init__(self, make: Callable[[list], Sequence[Any]], most: int = MEMO, longest: int = LONG) -> None:
        self.make, self.most, self.longest = make, most, longest
        self.young: dict[Any, Any] = {}
        self.old: dict[Any, Any] = {}

    def values(self, keys: list) -> list[Any]:
        """The value of each key, in order."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = []
        for k in set(keys):
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    new.append(k)
        if new:
            young.update(zip(new, self.make(new), strict=True))
        got = list(map(young.__getitem__, keys))
        for k in new:
            if len(k) > self.longest:
                del young[k]
        return got


@lru_cache(maxsize=4)
def library(path: str, plain: bool):
    """A tokenizer of the tokenizers library; with ``plain``, special tokens' strings in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = plain
    return t


@lru_cache(maxsize=4)
def pieces(path: str):
    """A sentencepiece model."""
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def bytes_of(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary of the tokenizers library."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    t = library(path, True)
    special = {i for i, a in t.get_added_tokens_decoder().items() if a.special}
    words = [t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))]
    return [w.encode() if i in special else bytes(byte[c] for c in w) for i, w in enumerate(words)]


@lru_cache(maxsize=4)
def ranked(path: str):
    """The same byte-level vocabulary in tiktoken, which is three times as fast; None where ids aren't in the order of merges."""
    import public_tokenizers
    import tiktoken

    model = json.loads(Path(path).read_text())["model"]
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if [model["vocab"].get(m) for m in merges] != list(range(256, 256 + len(merges))):
        return None
    ranks = {b: i for i, b in enumerate(bytes_of(path)[: 256 + len(merges)])}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# Texts of these characters only are cut into the tokenizer's words here; none of them changes under NFC,
# and letters from U+00C0 to U+024F (less the two signs and dotted I) are letters to every library.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-įı-ɏ]*")
_PART = re.compile(r"(?<=\S) (?=\S)")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ɏ]+|[0-9]|[^\sa-z0-9à-öø-ɏ]+")


def cut_words(text: str) -> list[str]:
    """Strings that word_bpe_49k.json tokenises one by one to the ids of the whole text.

    It drops whitespace, so a text may be cut there; within plain letters its words are cut here
    too, which leaves fewer distinct ones. Its special tokens hold no whitespace.
    """
    if "<|" not in text and _PLAIN.fullmatch(text):
        return _WORD.findall(text.lower())
    return text.split(" ")


@lru_cache(maxsize=4)
def word_memo(path: str) -> Memo:
    """Ids (little-endian 32 bits) of the strings of :func:`cut_words`."""
    t = library(path, False)

    def make(new: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch_fast(new, add_special_tokens=False)]

    return Memo(make, WORDS)


def word_ids(path: str, text: str) -> np.ndarray:
    """The ids of a text by word_bpe_49k.json, without special tokens added; the same as of one call over the text."""
    return np.frombuffer(b"".join(word_memo(path).values(cut_words(text))), "<u4")


@lru_cache(maxsize=4)
def pieces_of(path: str) -> list[bytes]:
    """The bytes of each id of a sentencepiece model: U+2581 is a space, <0xHH> the byte HH."""
    p = pieces(path)
    return [bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode() for i in range(p.get_piece_size())]


def _checked(a: str, b: str, spaced: str, x: list[int], y: list[int]) -> tuple[bytes, bytes] | None:
    """Both ids (little-endian 32 bits), or None where their tokens' bytes are not those of the text."""
    of_a, of_b = bytes_of(a), pieces_of(b)
    same = b"".join([of_a[i] for i in x]) == spaced.encode() == b"".join([of_b[i] for i in y])
    return (array("I", x).tobytes(), array("I", y).tobytes()) if same else None


@lru_cache(maxsize=4)
def part_memo(a: str, b: str) -> Memo:
    """Ids of A and B of space+part, for parts of plain texts."""
    fast, slow, model = ranked(a), library(a, True), pieces(b)

    def make(new: list[str]) -> list[tuple[bytes, bytes] | None]:
        spaced = [" " + p for p in new]
        ids = map(fast.encode_ordinary, spaced) if fast else (e.ids for e in slow.encode_batch_fast(spaced, add_special_tokens=False))
        return [_checked(a, b, p, x, y) for p, x, y in zip(spaced, ids, model.encode(new, num_threads=1), strict=True)]

    return Memo(make)


def both_ids(a: str, b: str, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The ids of space+text by a file like byte_bpe_50k.json and by one like piece_bpe_32k.model; strings of special tokens are plain text.

    Both are empty where a text is null or empty, or where the tokens' joined bytes differ from it. Texts of plain letters
    are put together from their parts between single spaces: tokens of neither go on across a space between
    other characters, for it begins a word of A and a piece of B. Other texts are tokenised in one call.
    """
    none = np.zeros(0, np.int64)
    cut = [_PART.split(t) if t and _PLAIN.fullmatch(t) else [] for t in texts]
    got = part_memo(a, b).values([p for parts in cut for p in parts])
    out, at = [], 0
    for t, parts in zip(texts, cut, strict=True):
        found = got[at : at + len(parts)]
        at += len(parts)
        if t and not parts:
            found = [_checked(a, b, " " + t, library(a, True).encode(" " + t, add_special_tokens=False).ids, pieces(b).encode(t))]
        if not found or None in found:
            out.append((none, none))
        else:
            out.append(tuple(np.frombuffer(b"".join([g[i] for g in found]), np.uint32).astype(np.int64) for i in (0, 1)))
    return out


def forget() -> None:
    """Free this process's tokenizers and memos: a worker that Spark reuses for another step has no use for them there."""
    for kept in (part_memo, word_memo, ranked, bytes_of, pieces_of, pieces, library):
        kept.cache_clear()

"""Byte-pair encoding by states of prefixes.

For every prefix of a word its encoding ends in exactly one token, and what
precedes that token is the encoding of a shorter prefix. A word's encoding is
therefore a chain of *last tokens*, one for each prefix. A token may be last if
it is a suffix of the prefix and if no merge crosses the border between it and
the token that ends the shorter prefix. Words are visited in sorted order, which
is a depth-first walk of their trie: the states of a shared prefix are computed
once and kept on the stack.

Vocabulary-specific readers map tokens to strings over single characters, so one
walk serves merge-list vocabularies (a priority for each pair of tokens) and
piece vocabularies (a priority for each result).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

#: Offset of the character that stands for "this byte, and the word ends here".
END = 0x20000
INFINITE = 1 << 60


class PrefixBPE:
    """rank(a, b): the priority of merging tokens a and b (lower first), or None."""

    def __init__(self, tokens: dict[str, int], rank: Callable[[str, str], int | None]):
        self.tokens = tokens
        self.rank = rank
        #: The lengths of tokens by their last two characters, longest first.
        self.lengths: dict[str, list[int]] = {}
        for t in tokens:
            if len(t) > 1 and len(t) not in (known := self.lengths.setdefault(t[-2:], [])):
                known.append(len(t))
        for known in self.lengths.values():
            known.sort(reverse=True)
        self.spines: dict[str, tuple | None] = {}
        #: Whether merging a token's symbols gives the token; None while it isn't known.
        self.whole: dict[str, bool | None] = dict.fromkeys(tokens)
        self.pairs: dict[str, dict[str, bool]] = {}

    def merge(self, symbols: list[str]) -> tuple[list[str], list[tuple[int, int, str]]]:
        """The encoding by repeated merging, and its steps (priority, position, result)."""
        parts, steps = list(symbols), []
        while len(parts) > 1:
            best, at = INFINITE, -1
            for i in range(len(parts) - 1):
                r = self.rank(parts[i], parts[i + 1])
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            steps.append((best, at, parts[at]))
        return parts, steps

    def spine(self, token: str) -> tuple | None:
        """(reachable, in priority order, right edge, left edge): while merging the token's own
        symbols, the parts at either border with the priorities at which each came and went."""
        if token not in self.spines:
            parts, steps = self.merge(list(token))
            right, left, count = [[token[-1], -1, INFINITE]], [[token[0], -1, INFINITE]], len(token)
            for r, at, made in steps:
                if at == count - 2:
                    right[-1][2] = r
                    right.append([made, r, INFINITE])
                if at == 0:
                    left[-1][2] = r
                    left.append([made, r, INFINITE])
                count -= 1
            ranks = [s[0] for s in steps]
            self.spines[token] = (len(parts) == 1, ranks == sorted(ranks), right, left)
        return self.spines[token]

    def adjacent(self, a: str, b: str) -> bool:
        """Whether the encoding of a + b is a, then b."""
        row = self.pairs.get(a)
        if row is None:
            row = self.pairs[a] = {}
        known = row.get(b)
        if known is None:
            _, sorted_a, right, _ = self.spine(a)
            _, sorted_b, _, left = self.spine(b)
            if sorted_a and sorted_b:
                known = not any(
                    (r := self.rank(x, y)) is not None and r < gone_x and r <= gone_y and r > came_x and r > came_y
                    for x, came_x, gone_x in right
                    for y, came_y, gone_y in left
                )
                # a result that ranks before its own parts: only a full merge tells
                if known and any((r := self.rank(x, y)) is not None and (r <= cx or r <= cy) for x, cx, _ in right for y, cy, _ in left):
                    known = self.merge(list(a + b))[0] == [a, b]
            else:
                known = self.merge(list(a + b))[0] == [a, b]
            row[b] = known
        return known

    def walk(self, words: Iterable[str]) -> Iterator[tuple[str, list[str], int]]:
        """Each distinct word, in sorted order, with the last token of each of its prefixes (index 0 is empty) and
        how many characters it shares with the word before. The list is reused: read it before going on."""
        lengths, pairs, whole = self.lengths, self.pairs, self.whole
        last: list[str] = [""]
        before = ""
        for word in sorted(set(words)):
            shared = 0
            for x, y in zip(word, before, strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                found = word[end - 1]
                for length in lengths.get(word[end - 2 : end], ()) if end > 1 else ():
                    if length > end:
                        continue
                    t = word[end - length : end]
                    reached = whole.get(t, False)
                    if reached is None:
                        reached = whole[t] = self.spine(t)[0]
                    if not reached:
                        continue
                    if length < end:
                        a = last[end - length]
                        fits = pairs[a].get(t) if a in pairs else None
                        if not (self.adjacent(a, t) if fits is None else fits):
                            continue
                    found = t
                    break
                last.append(found)
            before = word
            yield word, last, shared

    @staticmethod
    def chain(last: list[str]) -> list[str]:
        """The tokens of the whole word, from the last tokens of its prefixes."""
        out, end = [], len(last) - 1
        while end > 0:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]


def byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others take the characters from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def read_word_vocabulary(path: str) -> tuple[PrefixBPE, list[str], dict[str, int]]:
    """A merge-list vocabulary with word ends: the encoder, the byte alphabet and the special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    suffix = spec["model"]["end_of_word_suffix"]

    def own(token: str) -> str:
        return token[: -len(suffix) - 1] + chr(ord(token[-len(suffix) - 1]) + END) if token.endswith(suffix) and len(token) > len(suffix) else token

    tokens = {own(t): i for t, i in spec["model"]["vocab"].items()}
    pairs = {}
    for k, m in enumerate(spec["model"]["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        pairs[own(a), own(b)] = k
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return PrefixBPE(tokens, lambda a, b: pairs.get((a, b))), byte_characters(), special


def read_piece_vocabulary(path: str) -> PrefixBPE:
    """A piece vocabulary: any two parts whose concatenation is a piece may merge, best score first."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    order = {s: k for k, s in enumerate(sorted({p.get_score(i) for i in ids}, reverse=True))}
    ranks = {p.id_to_piece(i): order[p.get_score(i)] for i in ids}
    return PrefixBPE({p.id_to_piece(i): i for i in ids}, lambda a, b: ranks.get(a + b))

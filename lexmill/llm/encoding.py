"""Token ids of whole texts, exactly those that the tokenizers library gives for a file, at several times its speed.

The merges run in tiktoken, which joins any two neighbours whose bytes together are a token; a tokenizers file
joins only the pairs that it lists. The two agree if every token that is used, taken alone, is made by its
listed pair: were another pair (a, b) of token t to meet first, no merge had crossed t's ends, so merging t
alone would have reached (a, b) as well, not the listed pair. `proved_merges` simulates the merging of each
token alone and leaves out the few that never form (no text can form those). A file whose words end with a
suffix is treated alike: the suffix is a byte of its own that joins the last byte before all other merges.

The classes of characters by which a text is split are taken for granted only within SAFE, blocks that are old
and the same for all libraries. A text with any other character, or with `<|` as in special strings, goes to
the tokenizers library whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

_PUNCTUATION = "‐-‧‰-⁞"
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Without U+0130, whose lower case is two characters.
SAFE = f"\\x02-\\x1b\\x20-\\x84\\x86-įı-ɏ{_PUNCTUATION}"
_UNSAFE = re.compile(f"[^{SAFE}]|<\\|").search
#: Runs of white space beyond this go to the library.
_LONG_SPACE = re.compile(r"\s{20000}").search
_MARK = "\x01"


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merge_alone(symbols: list[bytes], ranks: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """Byte-pair merging by listed pairs, lowest rank first, leftmost first."""
    while len(symbols) > 1:
        found = [(ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:]))]
        rank, i = min(found)
        if rank == 1 << 60:
            break
        pair, out, k = (symbols[i], symbols[i + 1]), [], 0
        while k < len(symbols):
            if k + 1 < len(symbols) and (symbols[k], symbols[k + 1]) == pair:
                out.append(symbols[k] + symbols[k + 1])
                k += 2
            else:
                out.append(symbols[k])
                k += 1
        symbols = out
    return symbols


def proved_merges(spec: dict) -> tuple[list[bytes], dict[bytes, int]]:
    """Tokens that form alone by the listed merges, in the order of those, and the ids of all; the suffix is the byte _MARK."""
    chars, suffix, mark = _byte_chars(), spec["model"]["end_of_word_suffix"] or "", _MARK.encode()

    def raw(s: str) -> bytes:
        end = bool(suffix) and s.endswith(suffix)
        return bytes(chars[c] for c in (s[: -len(suffix)] if end else s)) + mark * end

    ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
    pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
    ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
    tokens = []
    for a, b in ranks:
        t = a + b
        symbols = [t[i:i + 1] for i in range(len(t))]
        if suffix and t.endswith(mark):
            symbols[-2:] = [symbols[-2] + mark]
        if merge_alone(symbols, ranks) == [t]:
            tokens.append(t)
    return list(dict.fromkeys(tokens)), ids


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        spec = json.load(open(path))
        self.library = Tokenizer.from_file(path)
        tokens, ids = proved_merges(spec)
        self.words = spec["model"]["end_of_word_suffix"] is not None
        base = [bytes([b]) for b in range(256)]
        if self.words:
            base += [bytes([b]) + _MARK.encode() for b in range(256)]
        order = base + tokens
        self.core = tiktoken.Encoding(
            os.path.basename(path), pat_str=r"[^\x01]+\x01" if self.words else PATTERN, mergeable_ranks={t: r for r, t in enumerate(order)}, special_tokens={}
        )
        self.ids = np.array([ids.get(t, 0) for t in order], np.uint32)
        # Only what the file's own splitting gives; white space is dropped, so what stands between is split by itself.
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+").findall

    def one(self, text: str) -> np.ndarray:
        # The core's expression keeps a stack for each character of a run of white space.
        if _UNSAFE(text) or not self.words and _LONG_SPACE(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        if self.words:
            # All letters of SAFE are _LETTERS, so a word of letters alone is not split.
            words = [w if w.isalpha() else _MARK.join(self.split(w)) for w in text.lower().split()]
            if not words:
                return np.empty(0, "<u4")
            text = _MARK.join(words) + _MARK
        return self.ids[self.core.encode_to_numpy(text, disallowed_special=())]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text, its ids as little-endian unsigned 32-bit integers."""
        return [self.one(t).tobytes() for t in texts]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file; it stays for the worker's next tasks."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]

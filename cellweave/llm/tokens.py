"""Token ids of whole texts by the `tokenizers` library, with encoded pieces cached.

A text is cut only where its tokenizer is bound to cut as well, each distinct
piece is encoded once, and ids are gathered by array indexing:

* byte-level BPE without a normalizer, prefix space or other pre-tokenizer:
  before a space that follows another character than white space (such a
  space, or the run it begins, never joins the token before it), unless the
  vocabulary has tokens that run on over a space;
* tokenizers that drop white space: at ASCII white space;
* any other tokenizer: nowhere.

Texts that hold other white space characters, or for byte-level BPE a space
after white space, are encoded in one piece.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cellweave.llm._base import expand, trim
from cellweave.llm._words import TO_SPACE

#: White space outside 0x20 and 0x09-0x0D.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
#: A byte-level token with a space behind another byte; behind a no-break space it only comes up in texts that are encoded whole.
_RUNS_ON = re.compile("(?<!^)(?<!\u00c2\u0142)\u0120")
#: Cached pieces in each of two generations; an older one is dropped as a whole.  About 150 bytes each.
CACHE = 250_000


def cut_rule(path: str) -> str:
    """"space", "word" or "whole", from the tokenizer's own file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if before.get("type") == "ByteLevel" and normal is None and before.get("use_regex") and not before.get("add_prefix_space"):
        # A token that runs on over a space could span two pieces that are encoded side by side.
        return "whole" if any(_RUNS_ON.search(token) for token in spec["model"]["vocab"]) else "space"
    steps = before.get("pretokenizers") or []
    kinds = [n.get("type") for n in (normal or {}).get("normalizers", [])]
    drops = steps and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and "\\s" in steps[0]["pattern"].get("Regex", "")
    if drops and kinds == ["NFC", "Replace", "Lowercase"]:
        return "word"
    return "whole"


class Encoder:
    """Encodes lists of texts; one for each Python worker."""

    def __init__(self, path: str, cache: int = CACHE):
        self.cache = cache
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.rule = cut_rule(path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        if self.rule == "space":
            # A byte-level token is as many bytes long as its name has characters.
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for token, number in vocabulary.items():
                self.width[number] = len(token)

    def _odd(self, text: bytes) -> bool:
        """Whether a text needs more care than a cut before each space (at each, for words)."""
        if self.rule == "whole" or b"\xff" in text:
            return True
        if not text.isascii() and _OTHER_SPACE.search(text.decode("utf-8", "replace")):
            return True
        if any(c in text for c in (b"\x1c", b"\x1d", b"\x1e", b"\x1f")):
            return True
        return self.rule == "space" and any(c in text for c in (b"  ", b"\n ", b"\t ", b"\r ", b"\x0b ", b"\x0c "))

    def _together(self, pieces: list) -> list:
        """The ids of new pieces, encoded side by side in longer texts."""
        out: list = []
        for start in range(0, len(pieces), 256):
            part = pieces[start : start + 256]
            try:
                text = (b"" if self.rule == "space" else b" ").join(part).decode()
            except UnicodeDecodeError:
                part = [p.decode("utf-8", "replace").encode() for p in part]
                text = (b"" if self.rule == "space" else b" ").join(part).decode()
            if self.rule == "space":
                ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                cuts = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(list(map(len, part))), side="right")
            else:
                made = self.tokenizer.encode(text, add_special_tokens=False)
                ids = np.array(made.ids, np.uint32)
                begins = np.array([a for a, _ in made.offsets], np.int64)
                sizes = list(map(len, part)) if text.isascii() else [len(p.decode()) for p in part]
                cuts = np.searchsorted(begins, np.cumsum(sizes) + np.arange(1, len(part) + 1), side="left")
            body, last = ids.tobytes(), 0
            for cut in (cuts * 4).tolist():
                out.append(body[last:cut])
                last = cut
        return out

    def _lookup(self, keys: list) -> list:
        """The ids of each distinct piece as bytes of unsigned 32-bit integers."""
        young, old = self.young, self.old
        found = [young.get(p) for p in keys]
        missing = []
        for i, ids in enumerate(found):
            if ids is None:
                ids = old.get(keys[i])
                if ids is None:
                    missing.append(i)
                else:
                    found[i] = young[keys[i]] = ids
        if missing:
            for i, ids in zip(missing, self._together([keys[i] for i in missing])):
                found[i] = ids
                if len(keys[i]) <= 64:
                    young[keys[i]] = ids
        if len(young) > self.cache:
            self.old, self.young = young, {}
        return found

    def _whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32).tobytes()

    def encode(self, texts: list, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): all ids in one array, each text's followed by `end`; None counts as empty."""
        plain: list = []
        for i, text in enumerate(texts):
            if not text:
                plain.append(b"")
            elif self._odd(text):
                plain.append(b"\xff%d" % i)
            else:
                plain.append(text.translate(TO_SPACE) if self.rule == "word" else text)
        parts = pc.split_pattern(pa.array(plain, pa.large_binary()), b" ")
        del plain
        bounds = parts.offsets.to_numpy()
        coded = parts.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        number = coded.indices.to_numpy(zero_copy_only=False).copy()
        lead = b" " if self.rule == "space" else b""
        usual = [i for i, p in enumerate(distinct) if p[:1] != b"\xff"]
        found: list = [b""] * len(distinct)
        for i, ids in zip(usual, self._lookup([lead + distinct[i] for i in usual]) if usual else []):
            found[i] = ids
        if self.rule == "word":
            found = [b"" if not p else ids for p, ids in zip(distinct, found)]
        for i, p in enumerate(distinct):
            if p[:1] == b"\xff":
                found[i] = self._whole(texts[int(p[1:])])
        if lead and len(bounds) > 1:
            # A text's first part has no space before it.
            heads = bounds[:-1]
            first, place = np.unique(number[heads], return_inverse=True)
            number[heads] = len(found) + place
            keep = [i for i in first.tolist() if distinct[i] and distinct[i][:1] != b"\xff"]
            made = dict(zip(keep, self._first([distinct[i] for i in keep])))
            found += [made.get(i, found[i] if distinct[i] else b"") for i in first.tolist()]
        # The end id is one more piece after each text's own.
        found.append(np.array([end], np.uint32).tobytes())
        number = np.insert(number, bounds[1:], len(found) - 1) if len(texts) else number
        sizes = np.array([len(b) // 4 for b in found], np.int64)
        flat = np.frombuffer(b"".join(found), np.uint32)
        del found, distinct, coded, parts
        counts = sizes[number]
        ids = flat[expand((np.cumsum(sizes) - sizes)[number], counts)]
        places = np.r_[0, np.cumsum(counts)][bounds + np.arange(len(bounds))] if len(texts) else np.zeros(1, np.int64)
        trim()
        return ids, places

    def _first(self, parts: list) -> list:
        """Ids of parts that stand first in a text."""
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch([p.decode("utf-8", "replace") for p in parts], add_special_tokens=False)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, cache: int = CACHE) -> Encoder:
    """The worker's encoder of that file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, cache)
    return _ENCODERS[path]

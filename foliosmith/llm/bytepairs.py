"""Token ids of byte-level byte-pair vocabularies, fast and in bounded memory.

The ids are those of the full tokenizer of a vocabulary file.  Where the file's merges are in the order of their ids, as in public
vocabularies of this kind, the same merges are run by a faster library on the same pattern; a file that is not so, and texts with
characters that the two libraries may class differently, go to the full tokenizer.  Long texts are cut where no token can cross: before
white space that follows a character which is none.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np

# The public pattern that splits texts before byte pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Blocks that have been complete since long before either library: Latin to Cyrillic, general punctuation and symbols, kana, Han, Hangul.
_SETTLED = re.compile(r"[\x00-ɏΑ-ΡΣ-ώЀ-џ‐-‧‰-⁞₠-₵←-⇿ぁ-ゖァ-ヺ一-龥가-힣]*\Z")
_CUT = re.compile(r"(?<=[!-~])(?=[ \t\n])")


def bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of the byte-level alphabet stands for: printable Latin-1 for itself, then the rest from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(own)))}


class BytePairs:
    """Token ids by the vocabulary file at ``path``."""

    def __init__(self, path: str, stretch: int = 1 << 19):
        """``stretch``: characters that are tokenized at once, where the text can be cut."""
        from tokenizers import Tokenizer

        self.full, self.stretch = Tokenizer.from_file(path), stretch
        with open(path, encoding="utf-8") as file:
            self.fast = self._fast(json.load(file))
        self.special = {t.content for t in self.full.get_added_tokens_decoder().values()}
        self.dtype = np.dtype("<u2" if self.full.get_vocab_size() <= 1 << 16 else "<u4")

    def _fast(self, file: dict):
        """The same merges in the faster library, or nothing if the file has more than merges in the order of ids."""
        split, model, letters = file.get("pre_tokenizer") or {}, file["model"], bytes_of_letters()
        plain = model.get("type") == "BPE" and not file.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        if not plain or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        vocab = model["vocab"]
        merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        if any(a is None or b is None or a >= b for a, b in zip(merged, merged[1:])):
            return None
        added = {t["content"] for t in file.get("added_tokens", [])}
        import tiktoken

        ranks = {bytes(letters[c] for c in token): k for token, k in vocab.items() if token not in added}
        return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _slices(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > self.stretch:
            cut = _CUT.search(text, at + self.stretch)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def ids(self, text: str) -> np.ndarray:
        """The ids of a whole text, without any that a template would add."""
        found = []
        for part in self._slices(text):
            if self.fast is not None and _SETTLED.match(part) and not any(s in part for s in self.special):
                found.append(np.array(self.fast.encode_ordinary(part), self.dtype))
            else:
                found.append(np.array(self.full.encode(part, add_special_tokens=False).ids, self.dtype))
        return found[0] if len(found) == 1 else np.concatenate(found)


@cache
def byte_pairs(path: str) -> BytePairs:
    """The tokenizer of a vocabulary file, kept by each Python worker."""
    return BytePairs(path)

"""Token ids of whole texts, with what a word becomes remembered for the life of a Python worker.

The tokenizer splits at white space, so a text is the sequence of its words; a word is encoded
once per worker and its ids are then looked up.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from climrisk.llm.common import worker_cache

#: Words remembered by one worker; beyond that the memory starts anew.
REMEMBERED = 600_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian unsigned 32-bit numbers.

    Equal to Tokenizer.encode(text, add_special_tokens=False) of the tokenizer as loaded: the name of
    a special token within a text is that token. A text that may hold one is encoded whole.
    """
    cache = worker_cache("tokens")
    if cache.get("path") != path:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        # What added tokens begin with; neither lower case nor composing characters makes it anew.
        begins = {t.content[:2] for t in tokenizer.get_added_tokens_decoder().values()}
        cache.update(path=path, tokenizer=tokenizer, words={}, parts={}, begins=begins)
    tokenizer, words, parts, begins = cache["tokenizer"], cache["words"], cache["parts"], cache["begins"]
    model = tokenizer.model
    split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z\xdf-\xf6\xf8-\xff0-9]+")
    # Plain words take the short way: Latin-1 letters, digits and ASCII signs, already normalised.
    plain = re.compile(r"[!-~\xc0-\xd6\xd8-\xde\xdf-\xf6\xf8-\xff]+\Z")
    # The vocabulary spells a byte as a printable character: itself, or the next one from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {b: chr(b) for b in shown}
    spelled |= {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}

    def packed(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def part(text: str) -> bytes:
        if text not in parts:
            parts[text] = packed([t.id for t in model.tokenize("".join([spelled[b] for b in text.encode()]))])
        return parts[text]

    def word(text: str) -> bytes:
        if plain.match(text):
            return b"".join([part(p) for p in split.findall(text.lower())])
        return packed(tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(text: str) -> bytes:
        if any(b in text for b in begins):
            return packed(tokenizer.encode(text, add_special_tokens=False).ids)
        if len(words) + len(parts) > REMEMBERED:
            words.clear()
            parts.clear()
        said = text.replace("\n", " ").replace("\t", " ").split(" ")
        try:
            return b"".join([words[w] for w in said])
        except KeyError:
            for w in said:
                if w not in words:
                    words[w] = word(w) if w else b""
            return b"".join([words[w] for w in said])

    return encode


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str]]:
    """(doc_id, text) of every row; a null text is empty."""
    for batch in batches:
        for row_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            yield row_id, text or ""

"""Byte-level BPE through the tokenizers library, with a bounded memo of space-led pieces.

The vocabulary's splitting pattern always cuts before a space that a non-space character
follows, so a text may be cut there and each piece encoded by itself. The pieces of a batch
are dictionary-encoded; each distinct one is looked up once, unknown ones go through the
tokenizer in one call, and the ids are gathered back in the order of the text. Texts in
which white space follows a space, and those that hold the content of an added token, are
encoded whole; so are all texts if the vocabulary does not split as described.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: White space, or the end, after a space.
_ODD = " ([\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|$)"
_encoders: dict = {}


def vocabulary_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _splits_at_spaces(tok) -> bool:
    """Whether the vocabulary cuts before each space that a word follows, and changes no text before that."""
    kind = json.loads(tok.to_str())
    cut = kind.get("pre_tokenizer") or {}
    return kind.get("normalizer") is None and kind.get("post_processor") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")


class Encoder:
    """memo_bytes bounds the words remembered, by their own bytes and those of their ids; all are forgotten beyond it."""

    def __init__(self, path: str, memo_bytes: int = 64 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.memo, self.held, self.limit, self.pieces = {}, 0, memo_bytes, _splits_at_spaces(self.tok)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.space_led = np.zeros(self.tok.get_vocab_size(), bool)
        for piece, i in self.tok.get_vocab().items():
            self.space_led[i] = piece.startswith("Ġ")

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """A word and one sign are two words of the pattern, so only the word is encoded."""
        memo, bases, signed, signs = self.memo, {}, [], {}
        for w in words:
            if not w[-1].isalnum() and w[:-1].isalpha():
                signed.append(w)
                signs[w[-1]] = b""
                if w[:-1] not in memo:
                    bases[w[:-1]] = None
            else:
                bases[w] = None
        signs = dict(zip(signs, self._whole(list(signs))))
        bases = list(bases)
        chunks = [bases[a : a + 200] for a in range(0, len(bases), 200)]
        for chunk, e in zip(chunks, self.tok.encode_batch_fast([" " + " ".join(c) for c in chunks], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            at = (np.append(np.flatnonzero(self.space_led[ids]), len(ids)) * 4).tolist()
            raw = ids.tobytes()
            if len(at) == len(chunk) + 1:
                memo.update(zip(chunk, [raw[a:b] for a, b in zip(at, at[1:])]))
            else:  # a piece without exactly one space-led token
                memo.update(zip(chunk, self._whole([" " + w for w in chunk])))
        for w in signed:
            memo[w] = memo[w[:-1]] + signs[w[-1]]
        self.held += sum(100 + len(w) + len(memo[w]) for w in words)

    def encode(self, texts, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Texts (no nulls) -> (starts, ids): text k has ids[starts[k]:starts[k + 1]], end included."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        n = len(texts)
        if not n:
            return np.zeros(1, np.int64), np.zeros(0, "<u4")
        if self.held > self.limit:
            self.memo, self.held = {}, 0
        odd = pc.match_substring_regex(texts, _ODD) if self.pieces else pa.array(np.ones(n, bool))
        for content in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, content))
        lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        edge = lists.offsets.to_numpy().astype(np.int64)
        first = lists.values.take(pa.array(edge[:-1]))
        heads = self._whole(pc.if_else(odd, texts, first).to_pylist())
        coded = lists.values.dictionary_encode()
        distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        later = np.ones(len(codes), bool)
        later[edge[:-1]] = False
        used = np.zeros(len(distinct), bool)
        used[codes[later]] = True
        memo = self.memo
        names = [w if u else None for w, u in zip(distinct, used.tolist())]
        self._learn([w for w in names if w is not None and w not in memo])
        memo[None] = b""
        raws = [*map(memo.__getitem__, names), *heads]
        if self.held > self.limit:  # very long words, such as megabytes without a space
            self.memo, self.held = {}, 0
        lens = np.fromiter(map(len, raws), np.int64, len(raws)) // 4
        codes[edge[:-1]] = len(distinct) + np.arange(n)
        at = np.concatenate([[0], np.cumsum(lens)])
        flat = np.frombuffer(b"".join(raws), "<u4")
        ids = pa.LargeListArray.from_arrays(pa.array(at), pa.array(flat)).take(pa.array(codes)).flatten().to_numpy()
        size = np.add.reduceat(lens[codes], edge[:-1])
        starts = np.concatenate([[0], np.cumsum(size)])
        if end is None:
            return starts, ids
        closed = starts + np.arange(n + 1)
        out = np.full(closed[-1], end, "<u4")
        keep = np.ones(len(out), bool)
        keep[closed[1:] - 1] = False
        out[keep] = ids
        return closed, out


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]

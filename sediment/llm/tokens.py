"""Whole texts to token ids by the tokenizers library, each distinct piece of text encoded once.

A text is cut where the pre-tokenizer cuts in any case, the distinct pieces of a batch go through
Tokenizer.encode_batch_fast, and the ids are put together by numpy. Cuts are made only where both
neighbours are in SAFE, so that no class of white space of any library matters; what cannot be cut
this way is encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters beside which a cut at a space or a line end is known to be one of the pre-tokenizer's.
SAFE = "!-~¡-¬®-ɏ"
#: A cache of encoded pieces is emptied beyond this number.
CACHE_PIECES = 1_000_000
#: Bytes of text that are encoded at once.
CHUNK_BYTES = 8 << 20

#: Letters for every library that stay one letter in lower case (which the dotted capital I does not), and marks that always begin a piece of their own behind one.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-įı-ɏ", ".,;:!?"
_WORD = re.compile(rf"[{LETTERS}]+")
#: Words that are encoded as one text, and texts that are encoded at once: the library keeps over 100 bytes for each id of these.
TOGETHER, AT_ONCE = 200, 64
_PIECES = re.compile(rf"(?<=[{SAFE}])(?= [{SAFE}])|(?<=[{SAFE}])(?=\n[{SAFE}])")
#: Begins a piece that no space was before.
_GLUE = "\x01"
#: Besides a line end or a space between two SAFE characters, white space or anything else beside a separator needs the slow way.
_ODD = rf"(^|[^{SAFE}])[ \n]|[ \n]([^{SAFE}]|$)|{_GLUE}"


class Encoder:
    """ids of many texts. spaced: a piece keeps the white space before it (byte-level BPE); otherwise white space is dropped."""

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split, WhitespaceSplit

        self.tokenizer, self.spaced = Tokenizer.from_file(path), spaced
        self.vocab = self.tokenizer.get_vocab_size()
        #: Tokens that are found in a text before it is cut in pieces; texts that hold one are encoded whole.
        self.literals = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # single words, which the pre-tokenizer's pattern would leave as they are: many in a text, cut at the spaces
        self.together = Tokenizer.from_file(path)
        bytes_only = ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)
        self.together.pre_tokenizer = Sequence([Split(" ", "merged_with_next") if spaced else WhitespaceSplit(), bytes_only])
        every = "".join(chr(c) for c in range(0x250) if _WORD.fullmatch(chr(c)))
        self.lower = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str(every) == every.lower()
        if self.lower:  # all that the normalizer does to these letters
            self.together.normalizer = None
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.vocab)]
        #: Whether an id begins a word (spaced) or ends one.
        self.edge = np.array([x.startswith("Ġ") if spaced else x.endswith("</w>") for x in names])
        self._clear()

    def _clear(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.starts, self.lens = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of single words (each behind its space, if spaced) and their number for each."""
        glue = "" if self.spaced else " "
        texts = [glue.join(words[a : a + TOGETHER]) for a in range(0, len(words), TOGETHER)]
        found = [np.zeros(0, np.uint32)]
        for a in range(0, len(texts), AT_ONCE):
            part = [x.lower() for x in texts[a : a + AT_ONCE]] if self.lower else texts[a : a + AT_ONCE]
            found += [np.array(x.ids, np.uint32) for x in self.together.encode_batch_fast(part, add_special_tokens=False)]
        flat = np.concatenate(found)
        edges = np.flatnonzero(self.edge[flat])
        if len(edges) != len(words):
            raise ValueError("the vocabulary doesn't mark where words begin or end")
        return flat, np.diff(edges, append=len(flat)) if self.spaced else np.diff(edges, prepend=-1)

    def _apart(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got: list[list[int]] = []
        for a in range(0, len(pieces), AT_ONCE * TOGETHER):
            got += [x.ids for x in self.tokenizer.encode_batch_fast(pieces[a : a + AT_ONCE * TOGETHER], add_special_tokens=False)]
        lens = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for ids in got for i in ids), np.uint32, int(lens.sum())), lens

    def _codes(self, pieces: pa.Array) -> np.ndarray:
        """Numbers of pieces in the cache."""
        coded = pc.dictionary_encode(pieces)
        kinds = coded.dictionary
        if len(self.known) > CACHE_PIECES:
            self._clear()
        at = pc.index_in(kinds, value_set=self.known)
        absent = at.is_null().to_numpy(zero_copy_only=False)
        number = at.fill_null(0).to_numpy().astype(np.int64)
        if absent.any():
            new = kinds.filter(pa.array(absent))
            single = pc.match_substring_regex(new, rf"^{' ' * self.spaced}[{LETTERS}]+$")
            words, rest = new.filter(single), new.filter(pc.invert(single))
            (flat, lens), (more, more_lens) = self._together(words.to_pylist()), self._apart(rest.to_pylist())
            flat, lens, first = np.concatenate([flat, more]), np.concatenate([lens, more_lens]), len(self.known)
            one = single.to_numpy(zero_copy_only=False)
            number[absent] = first + np.where(one, np.cumsum(one) - 1, len(words) + np.cumsum(~one) - 1)
            starts = len(self.flat) + np.cumsum(lens) - lens
            self.known = pa.concat_arrays([self.known, words, rest])
            self.starts, self.lens, self.flat = np.concatenate([self.starts, starts]), np.concatenate([self.lens, lens]), np.concatenate([self.flat, flat])
        return number[coded.indices.to_numpy()]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other (uint32) and their number for each text (long)."""
        texts = texts.cast(pa.large_string())
        whole = np.zeros(len(texts), bool)
        for x in self.literals:
            whole |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._cut(texts)
        ids, counts = self._cut(pc.if_else(pa.array(whole), "", texts))
        slow, lens = self._apart(texts.filter(pa.array(whole)).to_pylist())
        counts[whole] = lens
        out, is_slow = np.zeros(int(counts.sum()), np.uint32), np.repeat(whole, counts)
        out[is_slow], out[~is_slow] = slow, ids
        return out, counts

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.spaced:
            odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
            marked = pc.replace_substring(texts, "\n", f" \n {_GLUE}")
            marked = pc.replace_substring_regex(marked, f"([{LETTERS}])([{MARKS}])", f"\\1 {_GLUE}\\2")
        else:
            odd, marked = np.zeros(n, bool), pc.replace_substring(texts, "\n", " ")
            marked = pc.replace_substring_regex(marked, f"([{LETTERS}])([{MARKS}])", "\\1 \\2")
        lists = pc.split_pattern(marked, " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values.slice(at[0], at[-1] - at[0])
        at = at - at[0]
        if self.spaced:
            owner_odd = np.repeat(odd, np.diff(at))
            first = np.zeros(len(words), bool)
            first[at[:-1][np.diff(at) > 0]] = True
            first &= ~owner_odd
            coded = pc.dictionary_encode(words)
            index, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
            used = np.zeros(len(names), bool)
            used[index[~owner_odd & ~first]] = True
            glued = pc.if_else(pc.starts_with(names, _GLUE), pc.utf8_slice_codeunits(names, 1), pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), names, pa.scalar("", pa.large_string())))
            keys = pc.if_else(pc.equal(names, "\n"), names, glued).filter(pa.array(used))
            heads = words.filter(pa.array(first))
            slow = [_PIECES.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
            every = self._codes(pa.concat_arrays([keys, heads, pa.array([p for x in slow for p in x], pa.large_string())]))
            table = np.zeros(len(names) + 1, np.int64)
            table[:-1][used] = every[: len(keys)]
            codes = table[index]
            codes[first] = every[len(keys) : len(keys) + len(heads)]
            rest = every[len(keys) + len(heads) :]
            if len(slow):
                counts = np.diff(at)
                counts[odd] = [len(x) for x in slow]
                whole = np.zeros(int(counts.sum()), np.int64)
                is_slow = np.repeat(odd, counts)
                whole[is_slow], whole[~is_slow] = rest, codes[~owner_odd]
                codes, at = whole, np.concatenate([[0], np.cumsum(counts)])
        else:
            codes = self._codes(words)
        lens = self.lens[codes]
        ends = np.cumsum(lens)
        pieces = pa.LargeListArray.from_arrays(pa.array(np.append(self.starts, len(self.flat))), pa.array(self.flat))
        ids = pieces.take(pa.array(codes)).flatten().to_numpy()
        bounds = np.concatenate([[0], ends])[at]
        return ids, np.diff(bounds)


def chunks(batch: pa.RecordBatch, column: str = "text"):
    """Parts of a batch with about CHUNK_BYTES of text each; one text is never cut."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes) - sizes) // CHUNK_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """One for each worker process, so that its cache serves all of its tasks."""
    if (path, spaced) not in _ENCODERS:
        _ENCODERS[path, spaced] = Encoder(path, spaced)
    return _ENCODERS[path, spaced]

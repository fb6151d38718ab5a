"""Public tokenizers, one instance a Python worker, over text cut where no token can span.

Both vocabularies used here split a text before applying merges, and none of their splits spans the place between a character that
is no white space and a single space or newline that is followed by another such character. A text is cut at those places, and the
pieces' ids are kept in a bounded cache, so each distinct word is encoded once by the tokenizers library and the ids are the same.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space in any of the libraries' senses, and marks that may combine with what stands before them, are never next to a cut.
_S = r"[^\s\x00-\x1f\x7f-\xa0̀-ͯ ᠎ -‏ -  -⁤　︀-️﻿]"
_NS = r"[\s\x00-\x1f\x7f-\xa0̀-ͯ ᠎ -‏ -  -⁤　︀-️﻿]"
CUT = re.compile(rf"(?:[ \n]?{_S}|{_NS}){_S}*(?:(?![ \n]{_S}){_NS}+{_S}*)*")


class IdCache:
    """A tokenizer with the ids of at most ``most`` pieces of at most ``longest`` characters kept.

    When that many are kept, those met in one batch only are forgotten; if that leaves more than half, the half met in most batches stays.

    ``encode_column`` cuts a whole batch at its single spaces and newlines, and before a comma or full stop that ends a word, in Arrow;
    encodes each distinct piece once and gathers the ids. Texts with other runs of white space there are cut by ``CUT``; the ids are
    the same either way.
    """

    def __init__(self, path: str, most: int = 800_000, longest: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core; more threads only wait for each other
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.opening = os.path.commonprefix(added)  # what all special tokens begin with
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE).search
        self.most, self.longest = most, longest
        alone = ((c, self.tokenizer.encode(f"a {c} a", add_special_tokens=False).ids) for c in SEPARATORS)
        self.between = next(((c, ids[1]) for c, ids in alone if len(ids) == 3), None)
        self.kept: dict[str, int] = {}  # piece -> its row in start, size and met
        self.start, self.size, self.met, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, "<u4")
        self.rows, self.used = 0, 0

    def _forget(self) -> None:
        """Keep what was met in two batches or more, at most half of ``most``; each meeting counts half from now on."""
        pieces, rows = list(self.kept), np.fromiter(self.kept.values(), np.int64, len(self.kept))
        stay = np.flatnonzero(self.met[rows] > 1)
        stay = stay[np.argsort(-self.met[rows[stay]], kind="stable")[: self.most // 2]]
        rows = rows[stay]
        self.pool, self.size, self.met = self._gather(rows), self.size[rows], self.met[rows] // 2
        self.start, self.rows, self.used = np.cumsum(self.size) - self.size, len(rows), len(self.pool)
        self.kept = {pieces[i]: k for k, i in enumerate(stay.tolist())}

    def _add(self, pieces: list[str]) -> None:
        joined = [p for p in pieces if (p[0] > "\x04" or p[0] == "\x01") and self.between[0] not in p] if self.between else []
        if joined and self._add_joined(joined):
            pieces = [p for p in pieces if p not in self.kept]
        if pieces:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([_whole(p) for p in pieces], add_special_tokens=False)]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            self._keep(pieces, size, np.fromiter(chain.from_iterable(ids), "<u4", int(size.sum())))

    def _add_joined(self, pieces: list[str], run: int = 500) -> bool:
        """Encode pieces in runs with a one-id separator after each: far cheaper than a call's result for every piece. False if they don't part again."""
        mark, mark_id = f" {self.between[0]}", self.between[1]
        whole = [_whole(p) for p in pieces]
        encoded = self.tokenizer.encode_batch_fast([mark.join(whole[i : i + run]) + mark for i in range(0, len(whole), run)], add_special_tokens=False)
        flat = np.concatenate([np.array(e.ids, "<u4") for e in encoded])
        ends = np.flatnonzero(flat == mark_id)
        if len(ends) != len(pieces):
            return False
        self._keep(pieces, np.diff(ends, prepend=-1) - 1, flat[flat != mark_id])
        return True

    def _keep(self, pieces: list[str], size: np.ndarray, flat: np.ndarray) -> None:
        rows, used = self.rows + len(pieces), self.used + len(flat)
        if rows > len(self.start):
            self.start, self.size, self.met = (np.concatenate([x[: self.rows], np.zeros(rows, x.dtype)]) for x in (self.start, self.size, self.met))
        if used > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(used, "<u4")])
        self.size[self.rows : rows], self.start[self.rows : rows], self.pool[self.used : used] = size, self.used + np.cumsum(size) - size, flat
        self.met[self.rows : rows] = 0
        self.kept.update(zip(pieces, range(self.rows, rows)))
        self.rows, self.used = rows, used

    def _look_up(self, pieces: list[str]) -> np.ndarray:
        found = self._kept_rows(pieces)
        new = np.flatnonzero(found < 0)
        if len(new):
            missing = list(dict.fromkeys([pieces[i] for i in new]))
            if self.rows + len(missing) > self.most:
                self._forget()
                found = self._kept_rows(pieces)
                new = np.flatnonzero(found < 0)
                missing = list(dict.fromkeys([pieces[i] for i in new]))
            self._add(missing)
            found[new] = [self.kept[pieces[i]] for i in new]
            for p in missing:
                if len(p) > self.longest:
                    del self.kept[p]
        self.met[found] += 1
        return found

    def _kept_rows(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.kept.get, pieces, repeat(-1)), np.int64, len(pieces))

    def _gather(self, rows: np.ndarray) -> np.ndarray:
        size = self.size[rows]
        ends = np.cumsum(size)
        return self.pool[np.repeat(self.start[rows] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def _has_special(self, text: str) -> bool:
        return self.opening in text and self.special(text) is not None

    def encode(self, text: str) -> np.ndarray:
        """A text's ids. A special token's own string gets that token's id, as in the library; such a text is encoded whole."""
        if self._has_special(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self._gather(self._look_up(["\x04" + p for p in CUT.findall(text)]))

    def encode_column(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in order, and where each text's ids start (one more entry: the end)."""
        marked = pa.array(["\x02" + t for t in texts], pa.large_string())
        plain = pc.replace_substring(marked, "\n", " \x01")  # a piece says by its first character what stood before it
        plain = pc.replace_substring_regex(plain, r"([0-9A-Za-z])([.,]) ", "\\1 \x03\\2 ")
        pieces = pc.split_pattern(plain, " ")
        flat = pieces.flatten().dictionary_encode()
        names = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        rows = np.repeat(np.arange(len(texts)), np.diff(pieces.offsets.to_numpy()))
        which = flat.indices.to_numpy()
        odd = np.fromiter((any(m in t for m in BEFORE) or self._has_special(t) for t in texts), bool, len(texts))
        plain_piece = pc.match_substring_regex(flat.dictionary, PLAIN).to_numpy(zero_copy_only=False)
        bad = np.zeros(len(names), bool)
        for i in np.flatnonzero(~plain_piece):
            bad[i] = not PIECE.fullmatch(names[i])
            if bad[i]:
                names[i] = "\x04."
        odd[rows[bad[which]]] = True
        if odd.any():
            which, rows = which[~odd[rows]], rows[~odd[rows]]
        row = self._look_up(names)[which]
        out, each = self._gather(row), np.bincount(rows, weights=self.size[row], minlength=len(texts)).astype(np.int64)
        if odd.any():
            cuts = np.concatenate([[0], np.cumsum(each)])
            parts = [self.encode(t) if o else out[a:b] for t, o, a, b in zip(texts, odd, cuts, cuts[1:])]
            each = np.array([len(p) for p in parts], np.int64)
            out = np.concatenate(parts)
        return out, np.concatenate([[0], np.cumsum(each)])


#: What a piece's first character says stood before it, if it isn't a space.
BEFORE = {"\x01": "\n", "\x02": "", "\x03": "", "\x04": ""}
#: Rare characters, one of which, where the vocabulary has it as one id, parts pieces that are encoded together.
SEPARATORS = "¶§®¬±|~^"
#: Pieces that need no closer look: an optional mark, then letters, digits and common marks of ASCII and of Latin-1.
PLAIN = r"^[\x01-\x03]?[!-~\x{a1}-\x{ac}\x{ae}-\x{ff}]+$"
#: A piece between single spaces: an optional mark, then text whose first and last characters are no white space.
PIECE = re.compile(rf"[\x01-\x03]?(?:{_S}|{_S}[^\x01-\x04]*{_S})")


def _whole(piece: str) -> str:
    """A piece with what stood before it."""
    return " " + piece if piece[0] > "\x04" else BEFORE[piece[0]] + piece[1:]


@lru_cache(maxsize=4)
def id_cache(path: str) -> IdCache:
    return IdCache(path)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def tiktoken_encoding(path: str):
    """A tiktoken encoding from a file of base64 tokens and ranks."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("from_file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

"""SentencePiece encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_NORMAL, _USER_DEFINED, _UNUSED, _BYTE = 1, 4, 5, 6
#: Symbols of a chunk: longer words are merged chunk by chunk, and joined where that gives the same.
CHUNK = 48
#: A word is a run of spaces and what follows up to the next space. No piece has
#: a space after another character (checked on loading), so no merge crosses words.
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Symbols that one call of the merge rounds takes.
STEP_CHARS = 400_000


class PieceModel:
    """A BPE model file: pieces, merge ranks and byte pieces.

    The vocabulary is turned into a table of pairs: for every piece and every
    way to cut it into two symbols that can arise, (left, right) has the rank of the
    piece. Symbols are numbered: known pieces by id, other characters after them.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        if spec.trainer_spec.model_type != 2 or spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a BPE model without normalisation is needed")
        if not (spec.normalizer_spec.add_dummy_prefix and spec.normalizer_spec.escape_whitespaces and spec.trainer_spec.byte_fallback):
            raise ValueError("a model with a dummy prefix, escaped spaces and byte fallback is needed")
        self.pieces = [p.piece for p in spec.pieces]
        kinds = [p.type for p in spec.pieces]
        if {_USER_DEFINED, _UNUSED} & set(kinds):
            raise ValueError("user-defined and unused pieces are not supported")
        self.kinds = kinds
        self.unk_id, self.eos_id = kinds.index(2), self.pieces.index("</s>")
        self.unk_surface = spec.trainer_spec.unk_surface
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == _NORMAL}
        if sorted(i for i, k in enumerate(kinds) if k != _NORMAL) != list(range(259)):
            raise ValueError("special and byte pieces must come first")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces with a space after another character are not supported")
        self.byte_ids = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        # Higher score first. Equal scores are equally good, so they share a rank.
        scores = sorted({spec.pieces[i].score for i in self.ids.values()}, reverse=True)
        place = {s: r for r, s in enumerate(scores)}
        self.n = len(self.pieces)
        keys, ranks, made = [], [], []
        for piece, i in self.ids.items():
            rank = place[spec.pieces[i].score]
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                # a single character is a symbol whether or not it is a piece
                a, b = self.ids.get(left), self.ids.get(right)
                if a is not None and b is not None:
                    keys.append(a * self.n + b)
                    ranks.append(rank)
                    made.append(i)
                elif (a is None and cut == 1) or (b is None and cut == len(piece) - 1):
                    raise ValueError("a piece with a character that is no piece is not supported")
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.ranks = np.array(ranks, dtype=np.int64)[order]
        self.made = np.array(made, dtype=np.int64)[order]
        self.length = np.array([len(p) for p in self.pieces], dtype=np.int64)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word, in merge rounds over as many words as a step takes."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(words):
            size, end = 0, at
            while end < len(words) and (size == 0 or size + len(words[end]) <= STEP_CHARS):
                size += len(words[end])
                end += 1
            part = words[at:end]
            out += self._expand(part, *self._merged(part))
            at = end
        return out

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words and the word of each, fully merged.

        A sequence of symbols is the whole word's result exactly if each two neighbours, encoded alone, stay
        the two that they are: no merge would then cross between them, whatever stands around. So
        words over CHUNK symbols are merged in chunks; where two chunks don't hold, the symbols around their border are
        merged anew together, with twice as many each time, until every border holds.
        """
        if max(map(len, words), default=0) <= CHUNK:
            return self._rounds(words)
        chunks = [w[i : i + CHUNK] for w in words for i in range(0, len(w), CHUNK)]
        per = np.array([-(-len(w) // CHUNK) for w in words])
        sym, chunk = self._rounds(chunks)
        word = np.repeat(np.arange(len(words)), per)[chunk]
        text = "".join(words)
        start = self._starts(sym)
        edges = np.flatnonzero((chunk[1:] != chunk[:-1]) & (word[1:] == word[:-1])) + 1
        reach = 2
        while len(edges := edges[~self._holds(sym[edges - 1], sym[edges])]):
            first, stop = np.searchsorted(word, word[edges]), np.searchsorted(word, word[edges], side="right")
            low, high = np.maximum(edges - reach, first), np.minimum(edges + reach, stop)
            # windows of one word that meet are one
            new = np.r_[True, (low[1:] > np.maximum.accumulate(high)[:-1]) | (word[edges[1:]] != word[edges[:-1]])]
            low, high = low[new], np.maximum.reduceat(high, np.flatnonzero(new))
            ends = np.r_[start, len(text)]
            again, window = self._rounds([text[a:b] for a, b in zip(ends[low].tolist(), ends[high].tolist(), strict=True)])
            size = np.bincount(window, minlength=len(low))
            # splice: every window's symbols take the place of the old ones
            inside = np.zeros(len(sym) + 1, dtype=np.int64)
            np.add.at(inside, low, 1)
            np.add.at(inside, high, -1)
            stay = np.cumsum(inside[:-1]) == 0
            order = np.argsort(np.concatenate([start[stay], np.repeat(start[low], size)]), kind="stable")
            owner = np.concatenate([word[stay], np.repeat(word[low], size)])[order]
            borders = np.unique(np.concatenate([ends[low], ends[high]]))
            sym, word = np.concatenate([sym[stay], again])[order], owner
            start = self._starts(sym)
            edges = np.searchsorted(start, borders[(borders > 0) & (borders < len(text))])
            edges = edges[word[edges] == word[edges - 1]]
            reach *= 2
        return sym, word

    def _starts(self, sym: np.ndarray) -> np.ndarray:
        """Where each symbol begins in the text."""
        size = np.where(sym >= 0, self.length[np.maximum(sym, 0)], 1)
        return np.cumsum(size) - size

    def _holds(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two neighbouring symbols, encoded by themselves, stay what they are."""
        key, back = np.unique(np.stack([left, right], axis=1), axis=0, return_inverse=True)
        shown = lambda s: self.pieces[s] if s >= 0 else chr(-1 - s)
        sym, word = self._rounds([shown(a) + shown(b) for a, b in key.tolist()])
        at = np.searchsorted(word, np.arange(len(key)))
        two = np.bincount(word, minlength=len(key)) == 2
        return (two & (sym[at] == key[:, 0]) & (sym[np.minimum(at + 1, len(sym) - 1)] == key[:, 1]))[back.ravel()] if len(key) else np.zeros(0, dtype=bool)

    def _symbols(self, text: str) -> np.ndarray:
        """Ids of the characters; those that are no piece as -1 minus the code point."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        found, back = np.unique(points, return_inverse=True)
        own = np.array([self.ids.get(chr(c), -1 - int(c)) for c in found], dtype=np.int64)
        return own[back]

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and place in the pair table; the rank of no pair is the largest integer."""
        key = np.where((left >= 0) & (right >= 0), left * self.n + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], np.iinfo(np.int64).max), at

    def _rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over flat symbol arrays: symbols and the word of each.

        In every round each word finds its smallest pair rank (a segmented minimum)
        and merges its pairs of that rank from the left; all words at once. The arrays
        are compacted after each round, and a word without a pair leaves them.
        """
        none = np.iinfo(np.int64).max
        sym = self._symbols("".join(words))
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        rank, place = np.full(len(sym), none), np.zeros(len(sym), dtype=np.int64)
        r, p = self._lookup(sym[:-1], sym[1:])
        inside = word[:-1] == word[1:]
        rank[:-1], place[:-1] = np.where(inside, r, none), p
        done_sym, done_word = [], []
        while len(sym):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, start)
            length = np.diff(np.r_[start, len(sym)])
            live = least != none
            if not live.all():
                keep = np.repeat(live, length)
                done_sym.append(sym[~keep])
                done_word.append(word[~keep])
                sym, word, rank, place = sym[keep], word[keep], rank[keep], place[keep]
                least, length = least[live], length[live]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, length))
            if len(hit) > len(least):
                hit = self._together(hit, sym, word, rank, place)
            sym[hit] = self.made[place[hit]]
            stay = np.ones(len(sym), dtype=bool)
            stay[hit + 1] = False
            at = hit - np.arange(len(hit))  # where the merged symbols are after compaction
            sym, word, rank, place = sym[stay], word[stay], rank[stay], place[stay]
            # Only the pairs on both sides of a merged symbol are new.
            for left in (at[at > 0] - 1, at):
                nxt = np.minimum(left + 1, len(sym) - 1)
                r, p = self._lookup(sym[left], sym[nxt])
                rank[left] = np.where((nxt > left) & (word[left] == word[nxt]), r, none)
                place[left] = p
        sym = np.concatenate(done_sym) if done_sym else np.zeros(0, dtype=np.int64)
        word = np.concatenate(done_word) if done_word else np.zeros(0, dtype=np.int64)
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def _together(self, hit: np.ndarray, sym: np.ndarray, word: np.ndarray, rank: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of the pairs of least rank, those that merge in one round just as they would one by one from the left.

        Of pairs that share a symbol the left one merges. Where a merged symbol makes a pair that
        comes before the ones still waiting, its word's later pairs wait for the next round.
        """
        fresh = np.r_[True, (hit[1:] != hit[:-1] + 1) | (word[hit[1:]] != word[hit[:-1]])]
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
        made, own = self.made[place[hit]], word[hit]
        after = np.minimum(hit + 2, len(sym) - 1)
        right, _ = self._lookup(made, sym[after])
        right = np.where((after == hit + 2) & (word[after] == own), right, np.iinfo(np.int64).max)
        before = np.maximum(hit - 1, 0)
        near = np.r_[False, hit[1:] == hit[:-1] + 2]  # the symbol before is merged as well
        left, _ = self._lookup(np.where(near, np.r_[0, made[:-1]], sym[before]), made)
        left = np.where((hit > 0) & (word[before] == own), left, np.iinfo(np.int64).max)
        early = np.minimum(left, right) <= rank[hit]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        stop = np.minimum.reduceat(np.where(early, np.arange(len(hit)), len(hit)), first)
        return hit[np.arange(len(hit)) <= np.repeat(stop, np.diff(np.r_[first, len(hit)]))]

    def _expand(self, words: list[str], sym: np.ndarray, word: np.ndarray) -> list[np.ndarray]:
        """Characters that are no piece become their UTF-8 bytes; then cut by word."""
        other = np.flatnonzero(sym < 0)
        if len(other):
            raw = [[self.byte_ids[b] for b in chr(-1 - int(s)).encode("utf-8", "surrogatepass")] for s in sym[other]]
            times = np.ones(len(sym), dtype=np.int64)
            times[other] = [len(r) for r in raw]
            word = np.repeat(word, times)
            first = np.cumsum(times) - times
            sym = np.repeat(sym, times)
            for at, r in zip(first[other], raw, strict=True):
                sym[at : at + len(r)] = r
        ends = np.searchsorted(word, np.arange(1, len(words) + 1)).tolist()
        sym = sym.astype(np.int32)
        return [sym[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def split(self, text: str) -> list[str]:
        """Words of the text as the encoder sees it: spaces escaped, one put in front. Empty texts have none."""
        return _WORDS.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        """Ids of the text, without an end id."""
        words = self.split(text)
        return [int(i) for part in self.encode_words(words) for i in part]

    def encode_texts(self, texts: list[str], known: Known) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids with the end id (of all texts, one after the other), how many each text has, and what they decode to.

        ``known`` keeps the ids and the decoded form of words from one call to the next. No
        character's bytes cross a word, so the decoded words joined are the decoded text.
        """
        split = [self.bare_words(t) for t in texts]
        new = list({w for words in split for w in words if w not in known.index})
        # the end id is the last entry, whatever words came before
        ids = self.encode_words([SPACE + w for w in new])
        known.add(new, ids, [self._surface(i) for i in ids], np.array([self.eos_id], dtype=np.int32))
        place, surface = known.index.__getitem__, known.surface.__getitem__
        listed: list[int] = []
        ends, decoded = [], []
        for words in split:
            row = list(map(place, words))
            decoded.append("".join(map(surface, row))[1:])
            listed += row
            listed.append(-1)
            ends.append(len(listed))
        flat = np.array(listed, dtype=np.int64)
        size = known.size[flat]
        begin = np.cumsum(size) - size
        all_ids = known.ids[np.repeat(known.start[flat] - begin, size) + np.arange(size.sum())]
        total = np.add.reduceat(size, [0, *ends[:-1]]) if ends else size
        known.forget_long()
        return all_ids, total, decoded

    def bare_words(self, text: str) -> list[str]:
        """Words of the text, each without the space in front of it. Empty texts have none."""
        if not text:
            return []
        words = text.replace(SPACE, " ").split(" ")
        return words if all(words) else [w[1:] for w in self.split(text)]

    def _surface(self, ids: np.ndarray) -> str:
        """The decoded form of a word inside a text: with its leading space."""
        listed = ids.tolist()
        if listed and min(listed) < 259:  # bytes and special pieces come first in the vocabulary
            space = self.ids[SPACE]
            return self.decode([space, *listed])
        return "".join([self.pieces[i] for i in listed]).replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, spaces restored, the one in front taken off; control pieces are silent.

        Each maximal run of byte pieces is read as UTF-8; a byte that fits no
        character becomes U+FFFD.
        """
        out: list[str] = []
        run = bytearray()
        start = True

        def flush() -> None:
            if run:
                out.append(_lenient(bytes(run)))
                run.clear()

        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                start = False
                continue
            flush()
            if self.kinds[i] == 3:
                continue
            if i == self.unk_id:
                out.append(self.unk_surface)
                start = False
                continue
            piece = self.pieces[i]
            if start:
                piece = piece[1:] if piece.startswith(SPACE) else piece
                start = False
            out.append(piece.replace(SPACE, " "))
        flush()
        return "".join(out)


def _lenient(data: bytes) -> str:
    """UTF-8, with U+FFFD for each byte that belongs to no character."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for size in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + size].decode("utf-8"))
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


#: Characters of words and ids that a worker remembers; beyond, it forgets all and starts anew. Longer words are not remembered.
REMEMBERED, LONGEST = 16_000_000, 64
#: Rows and characters of one step.
STEP_ROWS, STEP_TEXT = 256, 4_000_000


class Known:
    """Ids and decoded forms of the words met so far, bounded in characters.

    Entries lie one after the other in flat arrays; the last one, -1, is the end id.
    """

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.surface: list[str] = []
        self.ids, self.size, self.start = (np.zeros(0, dtype=t) for t in (np.int32, np.int64, np.int64))
        self.chars, self.long = 0, False

    def add(self, words: list[str], ids: list[np.ndarray], surfaces: list[str], end: np.ndarray) -> None:
        for w in words:
            self.index[w] = len(self.index)
        self.surface += surfaces
        self.ids = np.concatenate([self.ids[: -1 if len(self.ids) else None], *ids, end])
        self.size = np.concatenate([self.size[:-1], np.array([len(i) for i in ids], dtype=np.int64), [1]])
        self.start = np.cumsum(self.size) - self.size
        sizes = [len(w) for w in words]
        self.chars += sum(sizes)
        self.long = max(sizes, default=0) > LONGEST or self.long

    def forget_long(self) -> None:
        """Forget words over LONGEST characters, and everything beyond REMEMBERED characters."""
        if self.chars > REMEMBERED:
            self.clear()
        elif self.long:
            keep = [w for w in self.index if len(w) <= LONGEST]
            rows = np.array([self.index[w] for w in keep] + [len(self.index)], dtype=np.int64)
            size = self.size[rows]
            begin = np.cumsum(size) - size
            self.ids = self.ids[np.repeat(self.start[rows] - begin, size) + np.arange(size.sum())]
            self.surface = [self.surface[i] for i in rows[:-1]]
            self.index = {w: i for i, w in enumerate(keep)}
            self.size, self.start = size, begin
            self.chars, self.long = sum(map(len, keep)), False


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """All columns of ``docs`` with ``piece_ids`` and ``decoded``, for the whole of every text.

    ``piece_ids`` is exactly what the sentencepiece library gives for the model, with an end
    id and no start id; ``decoded`` is what the ids decode to. The
    model file must be readable under the same path on every executor.

    * null and empty texts: the end id alone, decoded to the empty text.
    * any characters, NUL and unpaired pieces of emoji included; unknown ones become bytes.
    * input columns named ``piece_ids`` or ``decoded`` are replaced.
    * empty table: empty result. Repeated rows are encoded one by one.
    """
    names = [c for c in docs.columns if c not in ("piece_ids", "decoded")]
    shape = docs.select(*names).withColumns({"piece_ids": F.array().cast("array<int>"), "decoded": F.lit("")}).schema
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = PieceModel(model_file), Known()
        for whole in batches:
            texts = [t or "" for t in whole.column(place).to_pylist()]
            sizes = np.cumsum([len(t) for t in texts])
            at = 0
            while at < len(texts):
                seen = int(sizes[at - 1]) if at else 0
                to = min(at + STEP_ROWS, max(at + 1, int(np.searchsorted(sizes, seen + STEP_TEXT))))
                ids, size, decoded = model.encode_texts(texts[at:to], known)
                listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*whole.slice(at, to - at).columns, listed, pa.array(decoded, pa.string())], [*names, "piece_ids", "decoded"])
                at = to

    return docs.select(*names).mapInArrow(run, shape)

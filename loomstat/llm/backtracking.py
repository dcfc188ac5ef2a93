"""SentencePiece encoding and decoding of merge-type models by backtracking.

A text's encoding is the one sequence of pieces in which every two neighbours are what merging
the two of them anew gives: a merge across a border of the true encoding would happen in its two
neighbours alone just as well. So pieces are tried, not merged: an Aho-Corasick automaton finds the
longest piece at each position; a piece is taken if it fits the one before it (merging both anew
gives back the two) and its end has not failed; else its next shorter prefix is tried; if none is
left, the position is marked in a bitfield of failed positions and the last piece taken back. Since
what leads to a position is unique, none is tried twice: time is linear in the text.

No merge crosses two characters that stand side by side in no piece. Where that holds between
letters and other signs and before white space, texts are encoded run by run of either, else whole;
the encodings of runs seen lately are remembered.

Edge cases: a null text counts as empty; an empty text has the end id alone; characters that the
model lacks become byte pieces; the white-space mark inside a text is a space to the model, as in
the library; texts and words of any length are encoded whole; repeated rows are encoded each; an
empty table gives no rows; other columns are not carried. Models need the merge type, byte
fallback and no user-defined or unused pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, strides, table

#: Fixed value: how models write a space.
SPACE = "▁"
#: Runs of letters or of other signs, each with the white space before it, and what a piece holds that crosses them.
RUN, CROSSING = rf"{SPACE}*[\p{{L}}\p{{M}}]+|{SPACE}*[^\p{{L}}\p{{M}}{SPACE}]+|{SPACE}+", rf"[\p{{L}}\p{{M}}][^\p{{L}}\p{{M}}]|[^\p{{L}}\p{{M}}{SPACE}][\p{{L}}\p{{M}}{SPACE}]"
#: Runs longer than this many characters are encoded each time, not remembered.
LONGEST_KEPT = 48
#: Runs that each of a Python worker's two generations of memory holds (about 80 MB each), and pairs of pieces.
MOST_KEPT, MOST_PAIRS = 250_000, 500_000
#: Ids that the library decodes in one go.
SEGMENT = 1 << 18
NEVER = float("-inf")


class Backtracker:
    """Encodes and decodes texts with the vocabulary of the model at ``path``."""

    def __init__(self, path: str):
        import ahocorasick
        import regex
        import sentencepiece

        self.library = model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [k for k in range(size) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(not model.is_byte(k) for k in self.bytes) or any(model.is_unused(k) for k in plain):
            raise ValueError(f"{path}: a model with byte fallback and without unused pieces is needed")
        self.end = model.eos_id()
        self.ids = {model.id_to_piece(k): k for k in plain}
        self.scores = {p: model.get_score(k) for p, k in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) > 1:
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        crossed = any(map(regex.compile(CROSSING).search, self.ids))
        self.runs = regex.compile("(?s).+" if crossed else RUN).findall
        self.identical = model.normalize(" a  ﬁ\n ") == f"{SPACE}{SPACE}a{SPACE}{SPACE}ﬁ\n{SPACE}"
        # stands before later segments, so that the library sees no start of a text there
        self.before = self.ids.get("a", self.bytes[97])
        self.pairs: dict[tuple[str, str], bool] = {}
        self.shorter: dict[str, str] = {}
        self.young: dict[str, tuple[tuple[int, ...], str]] = {}
        self.old: dict[str, tuple[tuple[int, ...], str]] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives: again and again the pair of highest score, the leftmost of several."""
        parts, score = list(text), self.scores.get
        scores = [score(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > NEVER:
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = score(parts[at - 1] + parts[at], NEVER)
            if at < len(scores):
                scores[at] = score(parts[at] + parts[at + 1], NEVER)
        return parts

    def _fits(self, last: str, piece: str) -> bool:
        """Whether both stay as they are when merged anew; ``last`` is empty at the start."""
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        found = self.pairs[last, piece] = self.merged(last + piece) == ([last, piece] if last else [piece])
        return found

    def _prefix(self, piece: str) -> str:
        """The longest piece that ``piece`` goes on from, or nothing; single characters are pieces."""
        found = next((piece[:k] for k in range(len(piece) - 1, 0, -1) if k == 1 or piece[:k] in self.ids), "")
        if piece in self.ids:
            self.shorter[piece] = found
        return found

    def pieces(self, text: str) -> list[str]:
        """The encoding of a text that is not empty, as pieces; a character that the model lacks stands for itself."""
        n = len(text)
        longest = list(text)
        for end, piece in self.automaton.iter(text):  # by end: of those with one start, the longest comes last
            longest[end + 1 - len(piece)] = piece
        failed = bytearray(n // 8 + 1)
        taken: list[str] = []
        known, shorter = self.pairs.get, self.shorter.get
        last, at, piece = "", 0, longest[0]
        while at < n:
            while piece:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1:
                    fits = known((last, piece))
                    if fits or (fits is None and self._fits(last, piece)):
                        break
                prefix = shorter(piece)
                piece = self._prefix(piece) if prefix is None else prefix
            if piece:
                taken.append(piece)
                last, at = piece, end
                piece = longest[at] if at < n else ""
            else:
                failed[at >> 3] |= 1 << (at & 7)
                back = taken.pop()
                at -= len(back)
                last, piece = taken[-1] if taken else "", self._prefix(back)
        return taken

    def _encoded(self, run: str) -> tuple[tuple[int, ...], str]:
        """The ids of a run, and the same in decimal."""
        ids: list[int] = []
        for piece in self.pieces(run):
            if (found := self.ids.get(piece)) is not None:
                ids.append(found)
            else:
                ids += map(self.bytes.__getitem__, piece.encode())
        return tuple(ids), " ".join(map(str, ids))

    def encode(self, text: str) -> tuple[list[int], str]:
        """The ids of a text with the end id, and the same in decimal, joined by spaces."""
        if not text:
            return [self.end], str(self.end)
        normal = SPACE + text.replace(" ", SPACE) if self.identical else self.library.normalize(text)
        runs = self.runs(normal)
        if len(self.young) > MOST_KEPT:
            self.old, self.young = self.young, {}
        lookup, long = self.young, {}
        for run in set(runs).difference(lookup):
            if len(run) > LONGEST_KEPT:
                long[run] = self._encoded(run)
            else:
                lookup[run] = self.old.get(run) or self._encoded(run)
        found = [long[r] if r in long else lookup[r] for r in runs] if long else list(map(lookup.__getitem__, runs))
        ids = list(chain.from_iterable([f[0] for f in found]))
        ids.append(self.end)
        return ids, " ".join([*(f[1] for f in found), str(self.end)])

    def decode(self, ids: list[int]) -> str:
        """What the library's decode gives, a segment at a time; segments start where a piece with a space does."""
        if len(ids) <= SEGMENT:
            return self.library.decode(ids)
        parts, start = [], 0
        while start < len(ids):
            end = start + SEGMENT
            while end < len(ids) and not self.library.id_to_piece(ids[end]).startswith(SPACE):
                end += 1
            some = ids[start:end]
            parts.append(self.library.decode([self.before, *some])[1:] if start else self.library.decode(some))
            start = end
        return "".join(parts)


def backtracker(path: str) -> Backtracker:
    """One for each Python worker, so that its tasks share what it remembers."""
    return kept(("pieces", path), lambda: Backtracker(path))


def encode_texts(docs: DataFrame, model_path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of ``docs`` (doc_id, text); ``with_ids`` adds ids and decoded."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = backtracker(model_path)
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            for start, texts in strides(batch.column(1)):
                counts, of_ids, of_texts, all_ids, all_texts = [], [], [], [], []
                for text in texts:
                    ids, decimal = coder.encode(text)
                    decoded = coder.decode(ids)
                    counts.append(len(ids))
                    of_ids.append(sha(decimal))
                    of_texts.append(sha(decoded))
                    if with_ids:
                        all_ids.append(ids)
                        all_texts.append(decoded)
                columns = [batch.column(0).slice(start, len(texts)), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())]
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_texts, pa.string())] if with_ids else []
                yield pa.RecordBatch.from_arrays(columns, names)

    more = ", ids array<int>, decoded string" if with_ids else ""
    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(encoded, schema)


def decode_ids(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of each row of ``encoded`` (doc_id, ids array<int>); null ids count as none."""
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = backtracker(model_path)
        for batch in batches:
            texts = [coder.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, f"doc_id {id_type}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under piece_bpe_32k.model, encoded and decoded again."""
    import public_tokenizers

    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)

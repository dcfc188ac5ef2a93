"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import public_tokenizers
import pytest

from helpers import documents, empty, texts
from loomstat.llm import backtracking
from loomstat.llm.backtracking import Backtracker

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def coder():
    return Backtracker(MODEL)


def hostile(coder) -> list[str]:
    random.seed(3)
    signs = [*"aeionrst  \n\t.,019ABxyzéüñ▁😀\x00ﬁ中", "  ", "   ", "<s>", "<0x41>", "</s>", "ing", "the", "नमस्ते", "á"]
    made = ["".join(random.choices(signs, k=random.choice([1, 2, 3, 5, 9, 20, 60]))) for _ in range(4000)]
    pieces = list(coder.ids)
    made += ["".join(random.choices(pieces, k=random.choice([1, 2, 3, 5, 9]))).replace("▁", random.choice("▁ ")) for _ in range(8000)]
    made += [f"a{chr(k)}b {chr(k)}" for k in range(0, 0x3000, 3)]
    return made + [t or "" for t in texts()]


def test_ids_and_texts_are_the_librarys(coder):
    for text in hostile(coder):
        wanted = coder.library.encode(text, add_eos=True)
        ids, decimal = coder.encode(text)
        assert ids == wanted, text[:100]
        assert decimal == " ".join(map(str, wanted))
        assert coder.decode(ids) == coder.library.decode(wanted)


def test_runs_and_whole_texts_have_one_encoding(coder):
    for text in hostile(coder)[::7]:
        normal = "▁" + text.replace(" ", "▁")
        assert coder.pieces(normal) == [p for run in coder.runs(normal) for p in coder.pieces(run)]
        if len(normal) < 300:
            assert coder.pieces(normal) == coder.merged(normal)


def test_backtracking_marks_and_skips_failed_positions(coder):
    # greedy longest matches alone are wrong for many runs
    random.seed(5)
    words = ["▁" + "".join(random.choices("aeinrstlo", k=9)) for _ in range(3000)]
    greedy_wrong = 0
    for word in words:
        rest, greedy = word, []
        while rest:
            piece = next(rest[:k] for k in range(min(16, len(rest)), 0, -1) if k == 1 or rest[:k] in coder.ids)
            greedy.append(piece)
            rest = rest[len(piece) :]
        found = coder.pieces(word)
        assert found == coder.merged(word)
        greedy_wrong += found != greedy
    assert greedy_wrong > 100


def test_memory_is_bounded_and_changes_nothing(coder, monkeypatch):
    monkeypatch.setattr(backtracking, "MOST_KEPT", 20)
    monkeypatch.setattr(backtracking, "MOST_PAIRS", 50)
    monkeypatch.setattr(backtracking, "LONGEST_KEPT", 6)
    monkeypatch.setattr(backtracking, "SEGMENT", 16)
    small = Backtracker(MODEL)
    for text in hostile(coder)[::5]:
        wanted = small.library.encode(text, add_eos=True)
        assert small.encode(text)[0] == wanted
        assert small.decode(wanted) == small.library.decode(wanted)
    assert len(small.pairs) <= 50


def test_operator_on_awkward_documents(spark, coder):
    docs = documents(spark)
    rows = backtracking.encode_texts(docs, MODEL).collect()
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    wanted = []
    for r in docs.collect():
        ids = coder.library.encode(r["text"] or "", add_eos=True)
        decoded = coder.library.decode(ids)
        wanted.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(decoded), ids, decoded))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, rows), key=key) == sorted(wanted, key=key)
    again = backtracking.decode_ids(backtracking.encode_texts(docs, MODEL), MODEL).collect()
    assert sorted((r["text"] for r in again)) == sorted(w[5] for w in wanted)
    assert backtracking.encode_texts(empty(spark), MODEL).count() == 0

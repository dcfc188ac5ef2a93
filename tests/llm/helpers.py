"""Frames with every awkward case, and brute-force versions of what operators compute."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "rank int, size string, word string, fp string, score string, place string, own_id string, copies string, base_spans string, Bucket string"


def texts() -> list[str | None]:
    random.seed(11)
    words = ["alpha", "beta", "Gamma,", "delta.", "it's", "élan", "naïve", "x1y2", "###", "42", "don't!!", "“quoted”", "😀"]
    prose = [" ".join(random.choices(words, k=n)) for n in (1, 2, 3, 7, 8, 9, 20, 60, 200)]
    lines = "one line here\n\n  \none line here\nanother\n" * 3
    return [
        None, "", " ", "\n\t \r\n", "a", "A", "ß", "٣", "!?", "\x00\x1c\x85\xa0", *prose, *prose[:3], lines,
        "same words again and again and so on " * 30,
        "x" * 70_000, "word " * 30_000, " " * 50_000, "a.b@" * 9_000, "1." * 20_000, "1 " * 30_000, "+1" * 20_000, "-" * 40_000,
        "mail bob.smith+x@mail.example.co.uk or a@b.c_d@e.f, not a@b", "ip 1.2.3.4 and 256.1.1.1 and 001.02.3.255 and 1.2.3.4.5.6.7.8",
        "card 4111 1111 1111 1111, 4111-1111-1111-1112, 4111111111111111x 378282246310005", "call +1 (017) 555-7713 or +44 20 7946 0958. +12 +1 2 3",
        "iban DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432 but DE89 3704 0044 0532 0130 01", "ssn 123-45-6789 social; 123-45-6789 " + "z " * 60,
        'token = "9dd3c80004c73dc9e548fee51c0b5a2d3f4e5a6b"', "<|endoftext|> in text <|ENDOFTEXT|>", "İstanbul ΣΑΣ ǅ ﬁ",
    ]


def documents(spark, clashing: bool = True):
    """Awkward texts under awkward metadata: null ids, langs and sources, and repeated rows."""
    rows = []
    for k, text in enumerate(texts()):
        source = ["s1", "s2", None, ""][k % 4] if k % 3 else "hot"
        rows.append((k if k != 5 else None, text, ["en", "fr", None][k % 3], source, len(text or "")))
    rows += [rows[12]] * 3 + [rows[0]] + [(900, "twin text of four words", "en", "s1", 23), (901, "twin text of four words", "en", "s1", 23)]
    df = spark.createDataFrame(rows, SCHEMA)
    if clashing:
        for column in CLASHING.split(", "):
            df = df.withColumn(column.split()[0], __import__("pyspark.sql.functions", fromlist=["lit"]).lit("1").cast(column.split()[1]))
    return df.repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def held(doc_id, by: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % by


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text or "") if ok(m.group(0))]

"""Queries over word images take documents of every length, against plain versions of them."""

from __future__ import annotations

from collections import Counter

import pytest

from lectern.plans import catalog, fixtures

ROWS = [(1, "ab c\n\nlong line", "en", "src1", 14), (2, "x" * 1500 + "\n" + "e" * 1500, "de", "src2", 3001), (3, "no count\nof chars", "fr", "src1", None), (4, " \n", "en", "src1", 2)]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{out}/documents.parquet")
    return out


def lines():
    return [(d, lang, source, k, line) for d, text, lang, source, _ in ROWS for k, line in enumerate(text.split("\n"), 1) if line.strip()]


def test_every_line_is_an_image(spark, folder):
    got = catalog.queries()["page_labels"](spark, folder).collect()
    pages = {}
    for d, lang, source, _, line in lines():
        pages.setdefault(f"{lang}_{source}_{d}", []).append(line)
    assert {r["page_key"]: r["labels"] for r in got} == {k: "\n".join(v) for k, v in pages.items()}


def test_word_cer_by_brute_force(spark, folder):
    e, want = fixtures.ENGINES["a"], Counter()
    for d, lang, source, k, line in lines():
        if (d + k) % e.absent == 0 or (7 * d + k) % e.error == 0:
            continue
        read = "" if (d + k) % e.empty == 0 else line.translate(str.maketrans(e.letters, e.become)) if k % e.swapped == 0 else line
        want[f"{lang}_{source}_{d}", k, levenshtein(line, read), len(line)] += 1
    got = Counter((r["page_key"], int(r["image_index"]), r["edits"], r["ref_chars"]) for r in catalog.queries()["word_cer"](spark, folder).collect())
    assert any(n == 1500 for *_, n in want) and got == want


def test_every_document_is_compared(spark, folder):
    assert {r["page_key"].rsplit("_", 1)[-1] for r in catalog.queries()["agreement_words"](spark, folder).select("page_key").collect()} == {"1", "2", "3"}
    assert not any("n_chars <" in sql for sql in catalog.oracle_sql().values())

"""Very many secrets in one text, equal rows in archives, sliced batches, bounded memory of words."""

import re
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from landroll.llm import archives, common, decontaminate, quality, secret_scan, tokens

MIXED = re.compile(secret_scan.MIXED)


def spans_by_hand(text):
    base = []
    for k, (_, pattern, group, least) in enumerate(secret_scan.KINDS):
        base += [(m.start(), k, m.end()) for m in re.finditer(pattern.replace(r"\x20", " "), text) if len(m.group(group)) >= least]
    varied = [m for m in MIXED.finditer(text) if all(re.search(c, m.group()) for c in ("[A-Z]", "[a-z]", "[0-9]"))]
    mixed = [(m.start(), 3, m.end()) for m in varied if not any(a < m.end() and m.start() < b for a, _, b in base)]
    return sorted(base), sorted(base + mixed)


def redacted_by_hand(text, spans):
    out, at = [], 0
    for start, _, stop in sorted(spans):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def text_with(n):
    """Secrets of all kinds, some inside or against others, after wide characters and past the ends of pieces and blocks."""
    parts = ["naïve \U0001f600 "]
    for i in range(n):
        parts.append(
            (
                f"token: {i:07d}{'abcdef0123456789abcdef':s}{i % 7}, ", f"Ab{i % 10}Cdefghijklmnopqrstuvw{i:06d} ", f"{'0123456789abcdef' * 2}-Xy ", "AKIA" + "Z9" * 9 + f"{i % 3} é ",
                "word " * (i % 900), f"secret={'0123456789abcdef' * 2} ", "short token=abc, ",
            )[i % 7]
        )
    return "".join(parts)


@pytest.mark.parametrize("n", [0, 1, 20, 400])
def test_spans_and_redaction_equal_brute_force(spark, n):
    text = text_with(n)
    docs = spark.createDataFrame([(1, text, "a", "b", len(text))], "doc_id int, text string, source string, lang string, n_chars int")
    base, every = spans_by_hand(text)
    names = [k for k, *_ in secret_scan.KINDS] + ["mixed"]
    found = secret_scan.scan_secrets(docs).first()
    assert found["spans"] == ",".join(f"{names[k]}:{a}:{b}" for a, k, b in every)
    assert [found[f"n_{name}"] for name in names[:3]] == [sum(k == i for _, k, _ in base) for i in range(3)]
    out = secret_scan.redact_secrets(docs).first()
    assert out["text"] == redacted_by_hand(text, every) and out["n_chars"] == (len(out["text"]) if every else len(text))


def test_time_follows_the_number_of_matches(spark):
    schema = "doc_id int, text string, source string, lang string, n_chars int"
    seconds = {}
    for n in (16_000, 16_000, 64_000):  # the first run also compiles
        text = "".join(f"tok {'abcdef0123456789abcdef%04x' % (i % 65536)} z" if i % 2 else f" Ab{i % 10}Cdefghijklmnopqrstuvw{i:06d} " for i in range(n))
        docs = spark.createDataFrame([(1, text, "a", "b", 1)], schema)
        start = time.perf_counter()
        assert secret_scan.redact_secrets(docs).select(F.length("text")).first()[0] < len(text)
        seconds[n] = time.perf_counter() - start
    assert seconds[64_000] < 10 * seconds[16_000]


def test_equal_rows_have_identifiers_of_their_own(spark):
    df = spark.createDataFrame([(1, "http://a/x", "same"), (1, "http://a/x", "same"), (2, "http://a/x", "same"), (None, "http://a/x", ""), (None, "http://a/x", "")], "page_id bigint, url string, html string")
    content = archives.arc_archives(df.coalesce(1))
    named = content.withColumn("archive", F.monotonically_increasing_id())
    ids = [r["record_id"] for r in archives.convert_arc(named, "archive").collect()]
    assert len(set(ids)) == len(ids) == 5
    assert ids == [r["record_id"] for r in archives.convert_arc(named, "archive").collect()]
    twice = archives.convert_arc(content.union(content)).select("record_id").collect()
    assert len(twice) == 10 and len({r["record_id"] for r in twice}) == 5  # archives that nothing tells apart
    found = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in archives.archive_pages(df).collect())
    assert found == [(0, "response", 0), (0, "response", 0), (1, "revisit", 2), (1, "revisit", 2), (2, "response", 0)]


def test_batches_are_sliced_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["aa", None, "b" * 10, "", "ccc", "dd"])], names=["i", "t"])
    parts = list(common.text_slices(batch, 1, 5))
    assert [p.num_rows for p in parts] == [2, 1, 3] and [x for p in parts for x in p.column(0).to_pylist()] == list(range(6))
    assert [p.num_rows for p in common.text_slices(batch.slice(0, 0), 1, 5)] == [0]


class Columns:
    """Stands for a table whose step is run by hand."""

    columns, schema = ("doc_id", "text"), "doc_id bigint, text string"

    def mapInArrow(self, run, schema):
        return run


def test_filters_return_long_batches_in_parts(monkeypatch):
    texts = ["quiet river road " * 2_000 + str(i) if i % 7 else None for i in range(700)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(700)), pa.array(texts)], names=["doc_id", "text"])
    size = quality.BUCKETS + quality.STATISTICS
    model = quality.Model(1.0, np.zeros(size, np.float32), np.zeros((size, quality.FACTORS), np.float32), 0)
    index = decontaminate.LeakIndex([(1, "one two three four five six seven eight nine ten")])
    monkeypatch.setattr(decontaminate, "_indexes", lambda *_: [index])
    for run, most in ((quality.keep_quality(Columns(), model), 3e6), (decontaminate.drop_leaks(Columns(), None), 7e6)):
        parts = list(run(iter([batch])))
        assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(700))
        assert [x for p in parts for x in p.column(1).to_pylist()] == texts
        assert max(p.get_total_buffer_size() for p in parts) < most


def test_remembered_words_are_few_and_common_ones_stay(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 500)
    coder = tokens.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    asked = []

    class Merges:
        def encode_batch_fast(self, words, add_special_tokens):
            asked.append(list(words))
            return own.encode_batch_fast(words, add_special_tokens=add_special_tokens)

    own, coder.merges = coder.merges, Merges()
    name = lambda i: "x" + "".join("abcdefghij"[int(c)] for c in str(i))
    for k in range(0, 6_000, 300):
        text = " ".join(["river", *map(name, range(k, k + 300))])
        assert coder.encode([text])[0].tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
    assert sum(words.count("river") for words in asked) == 1  # forgotten with all others before
    many = " ".join(map(name, range(10_000, 20_000)))
    assert coder.encode([many])[0].tolist() == coder.tokenizer.encode(many, add_special_tokens=False).ids
    assert max(map(len, asked)) <= 4_000

"""The registered queries themselves, digests included, over a written table of given and odd texts."""

import hashlib
import os
import zlib

import numpy as np
import pandas as pd
import pytest
from test_training_operators import BYTE, ODD, PII, SECRETS, WORD, brute_components, brute_fingerprint, brute_line_dedup, brute_pii, brute_secrets
from tokenizers import Tokenizer

from placelens.llm import bpe, pii, quality, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("tables")
    given = pd.read_parquet(f"{SF}/documents.parquet")
    odd = [*ODD, *SECRETS, *PII]
    made = pd.DataFrame({"doc_id": range(10**6, 10**6 + len(odd)), "text": odd, "source": [f"s{i % 3}" for i in range(len(odd))]})
    made["doc_id"] = made["doc_id"].astype(given["doc_id"].dtype)
    pd.concat([given, made]).sample(frac=1, random_state=3).to_parquet(out / "documents.parquet", index=False)
    return str(out)


@pytest.fixture(scope="module")
def texts(folder):
    docs = pd.read_parquet(f"{folder}/documents.parquet").sort_values("doc_id")
    return [(int(i), None if pd.isna(x) else x) for i, x in zip(docs["doc_id"], docs["text"])]


def result(spark, folder, name, *columns):
    got = queries.queries()[name](spark, folder).select("doc_id", *columns).collect()
    return sorted(tuple(r) for r in got)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def listed(spans):
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


_LIBRARY: dict[str, Tokenizer] = {}


def _library(path):
    if path not in _LIBRARY:
        _LIBRARY[path] = Tokenizer.from_file(path)
        _LIBRARY[path].no_truncation()
        _LIBRARY[path].no_padding()
    return _LIBRARY[path]


def ids(path, x):
    return _library(path).encode(x or "", add_special_tokens=False).ids


def test_op1_counts_tokens_as_the_library(spark, folder, texts):
    want = [(i, len((x or "").encode()), n := len(ids(WORD, x)), n > 2048) for i, x in texts]
    assert result(spark, folder, "op1_token_counts", "n_bytes", "n_tokens", "over_limit") == want


def test_op3_fingerprints_and_components(spark, folder, texts):
    prints = [brute_fingerprint(x) for _, x in texts]
    roots = brute_components(prints, 2)
    want = [(i, f"{p:016x}", texts[r][0]) for (i, _), p, r in zip(texts, prints, roots)]
    assert result(spark, folder, "op3_simhash", "fingerprint", "component_id") == want


def test_op4_encodes_and_decodes_as_the_library(spark, folder, texts):
    want = []
    for i, x in texts:
        own = ids(BYTE, x)
        want.append((i, len(own), sha(np.array(own, "<u4").tobytes()), sha(_library(BYTE).decode(own, skip_special_tokens=False))))
    assert result(spark, folder, "op4_bpe", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_op5_removes_repeated_lines(spark, folder, texts):
    want = [(i, n, sha(x or "")) for (i, _), (n, x) in zip(texts, brute_line_dedup([x for _, x in texts]))]
    assert result(spark, folder, "op5_line_dedup", "n_lines_removed", "text_sha256") == want


def test_op6_lists_base_spans(spark, folder, texts):
    got = result(spark, folder, "op6_secrets", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    for row, (i, x) in zip(got, texts, strict=True):
        base = brute_secrets(x or "")
        assert row[:5] == (i, *(sum(s[0] == kind for s in base) for kind in ("assign", "access", "hex")), sha(listed(base)))
        assert [s for s in row[5].split(",") if s.split(":")[0] in ("assign", "access", "hex")] == [s for s in listed(base).split(",") if s]


def test_op9_starts_and_checksums(spark, folder, texts):
    want, start = [], 0
    for i, x in texts:
        own = [*ids(WORD, x), 2]
        want.append((i, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert result(spark, folder, "op9_token_files", "start", "n_tokens", "ids_crc32") == want


def test_op10_lists_base_spans(spark, folder, texts):
    kinds = ("email", "ip", "card", "phone")
    got = result(spark, folder, "op10_pii", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    for row, (i, x) in zip(got, texts, strict=True):
        base = brute_pii(x or "")
        assert row[:6] == (i, *(sum(s[0] == kind for s in base) for kind in kinds), sha(listed(base)))
        assert [s for s in row[6].split(",") if s.split(":")[0] in kinds] == [s for s in listed(base).split(",") if s]


def test_decoding_takes_null_empty_repeated_and_long_arrays(spark):
    texts = [None, "", "a b", "a b", "long text " * 150_000, "日本語"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    encoded = bpe.encode(docs, BYTE)
    more = encoded.union(spark.createDataFrame([(9, None), (9, None)], encoded.schema))
    got = sorted((r.doc_id, r.text) for r in bpe.decode(more, BYTE).collect())
    assert got == [*((i, x or "") for i, x in enumerate(texts)), (9, ""), (9, "")]
    assert bpe.decode(encoded.limit(0), BYTE).count() == 0


def test_masking_and_kept_rows_of_odd_tables(spark):
    good = "the quick brown fox and that dog have been with the others to see what all of them do in this long day. "
    rows = [(1, None, "a"), (2, "", "b"), (3, "mail a@b.cd", "c"), (3, "mail a@b.cd", "c"), (4, good, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    assert sorted(((r.doc_id, r.text) for r in pii.masked(docs).collect()), key=str) == [(1, None), (2, ""), (3, "mail [email]"), (3, "mail [email]"), (4, good)]
    assert [tuple(r) for r in quality.kept_rows(docs).collect()] == [rows[4]]
    assert quality.kept_rows(docs.limit(0)).count() == pii.masked(docs.limit(0)).count() == 0

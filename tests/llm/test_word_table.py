import hashlib
import json

import pytest
from llm_texts import prose
from tokenizers import Tokenizer as Library

from atlasledger.llm import word_table
from atlasledger.llm.queries import TOKENIZER, op13_word_table
from atlasledger.llm.word_table import Tokenizer, decode, encode
from atlasledger.session import Scratch

ODD = [
    "a  b   c    d", "tabs\t\tand \n lines \r\n end  ", "   ", " x ", "it's we'll I'M 'tis ''s", "日本語 の 文 — ok ½ ²3 Ⅷ ٣", "a<|endoftext|> b<|endoftext|><|endoftext|>",
    "<|endoftext", " nbsp em　 wide ​", "é ǅ ʰ \U0001f600\U0001f468‍\U0001f469", "\x00\x1f\x7f\x85﻿", "ſ's 'ſ", "ßİiı", "x" * 5000, " " * 3000 + "y",
]


def library(special=True):
    out = Library.from_file(TOKENIZER)
    out.encode_special_tokens = not special
    return out


@pytest.mark.parametrize("special, block_bytes", [(True, word_table.BLOCK_BYTES), (False, 400)])
def test_equals_the_library(spark, make, special, block_bytes):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100 + k, prose(k, 40 * k)) for k in range(8)]
    lib = library(special)
    with Scratch(spark) as scratch:
        ids = encode(make(rows), scratch, TOKENIZER, special, block_bytes=block_bytes)
        got = decode(ids, TOKENIZER).collect()
        assert len(got) == len(rows)
        for r in got:
            want = lib.encode(dict(rows)[r.row.doc_id], add_special_tokens=False).ids
            assert r.ids == want and r.text == lib.decode(want, skip_special_tokens=False)


def test_awkward_rows(spark, make, awkward):
    lib = library()
    with Scratch(spark) as scratch:
        got = decode(encode(awkward, scratch, TOKENIZER), TOKENIZER).collect()
        rows = awkward.collect()
        key = lambda i, t: (-1 if i is None else i, t)
        assert sorted(key(r.row.doc_id, r.text) for r in got) == sorted(key(r.doc_id, r.text or "") for r in rows)
        assert all(r.ids == lib.encode(r.text, add_special_tokens=False).ids for r in got)
        assert set(got[0].row.asDict()) == set(awkward.columns) - {"text"}
        assert encode(make([]), scratch, TOKENIZER).rows().collect() == []
        only = encode(make([(1, None), (2, "")]), scratch, TOKENIZER).rows()
        assert [r.ids for r in only.collect()] == [[], []]


def test_long_texts_are_cut_where_nothing_joins(spark, make, monkeypatch):
    text = " ".join(ODD) + " " + prose(5, 400)
    lib = library()
    for part in (1, 7, 50):
        monkeypatch.setattr(word_table, "PART", part)
        block = word_table._Block(Tokenizer.at(TOKENIZER, True))
        codes = block._slow(text)
        words = list(block.code)
        assert [words[c] for c in codes] == list(Tokenizer.at(TOKENIZER, True).words(text))
    assert [i for w in words_of(codes, words) for i in w] == lib.encode(text, add_special_tokens=False).ids


def words_of(codes, words):
    ids = Tokenizer.at(TOKENIZER, True).ids(words)
    import numpy as np

    return [np.frombuffer(ids[c], "<u2").tolist() for c in codes]


def test_decoding_any_ids(spark):
    lib = library()
    rows = [(1, [0, 50256, 11]), (2, []), (3, None), (4, [165, 119]), (5, [1 << 20, 262, None]), (1, [50257, -5, 464])]
    ids = spark.createDataFrame([({"doc_id": i}, v) for i, v in rows], "row struct<doc_id:int>, ids array<int>")
    got = sorted((r.row.doc_id, r.text) for r in decode(ids, TOKENIZER).collect())
    plain = [[i for i in v or [] if i is not None and i >= 0] for _, v in rows]
    assert got == sorted((i, lib.decode(v, skip_special_tokens=False)) for (i, _), v in zip(rows, plain))


def test_other_tokenizers_are_refused(tmp_path):
    told = json.load(open(TOKENIZER))
    told["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(told))
    with pytest.raises(ValueError):
        Tokenizer(str(path), True)


def test_query_equals_the_library(spark, sf):
    lib = library()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op13_word_table(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        told = [",".join(map(str, ids)), lib.decode(ids, skip_special_tokens=False)]
        assert got[r.doc_id] == (len(ids), *(hashlib.sha256(t.encode()).hexdigest() for t in told))

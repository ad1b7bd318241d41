"""The codec, token counts and packing against the tokenizers library."""

from __future__ import annotations

import array
import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from lathework.llm import bpe, packing, token_counts
from lathework.llm.common import tokenizer_path

ALPHABET = "abcdehlnorstEé'Σλ12 .,!́　<|>😀\n"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def coder():
    return bpe.WordBpe(tokenizer_path("word_bpe_49k.json"))


def test_codec_equals_the_library_on_random_text(library, coder):
    draw = random.Random(5)
    texts = ["".join(draw.choice(ALPHABET) for _ in range(120)) for _ in range(400)]
    texts += ["", " ", "a" * 3000, "İstanbul ǅ ß ﬁ", "it's we'll I'M", "<|endoftext|>x<|startoftext|>", "a\x1fb \x85c", "½ Ⅷ ² ٣"]
    for text, ids in zip(texts, coder.encode(texts)):
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_fast_letter_between_letters_and_alone(library, coder):
    texts = [t for p in range(0xC0, 0x260) for c in [chr(p)] for t in (f"a{c}b", c, f"x {c} y", f"AL{c}M")]
    wanted = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert coder.encode(texts) == wanted
    coded = bpe.Coded(coder, lambda ids: ids)
    assert [[i for part in row for i in part] for row in coded.rows(texts)] == wanted


def test_digests_of_edge_rows(edge_docs, edge_rows, no_docs, library):
    vocabulary = tokenizer_path("word_bpe_49k.json")
    found = bpe.token_digests(edge_docs, vocabulary).collect()
    wanted = []
    for key, text, *_ in edge_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        wanted.append((key, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), said))))
    assert sorted(str(tuple(r)) for r in found) == sorted(map(str, wanted))
    assert bpe.token_digests(no_docs, vocabulary).count() == 0
    assert {r["doc_id"]: r["ids"] for r in bpe.encode_documents(edge_docs, vocabulary).collect()}[2] == []


def test_counts_equal_the_unigram_model(edge_docs, edge_rows, no_docs):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    library = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(prepend_scheme="always")]
    )
    counter = token_counts.UnigramCounter(pieces)
    draw = random.Random(7)
    for _ in range(300):
        text = "".join(draw.choice("abcdethéλ你😀▁ ٣🙂<0x>unk_s/\t") for _ in range(50))
        assert sum(counter.chunk(c)[0] for c in text.split()) == len(library.encode(text).ids)
    found = sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_counts.count_tokens(edge_docs, path).collect())
    # the library's splitter takes no separator control for a blank
    assert found == sorted((str(k), len(library.encode((t or "").replace("\x1c", " ")).ids)) for k, t, *_ in edge_rows)
    assert token_counts.count_tokens(no_docs, path).count() == 0


def test_ties_go_to_the_piece_that_starts_first():
    # ▁a+bc and ▁ab+c score the same; the longer last piece wins, so the count is that of ▁a+bc and then one more piece
    pieces = [("<unk>", 0.0), ("▁a", -1.0), ("bc", -2.0), ("▁ab", -2.0), ("c", -1.0), ("▁", -9.0), ("b", -9.0)]
    library = Tokenizer(models.Unigram(pieces, unk_id=0))
    counter = token_counts.UnigramCounter(pieces)
    assert counter.word("▁abc")[0] == len(library.encode("▁abc").ids) == 2
    assert counter.word("▁zzc")[0] == len(library.encode("▁zzc").ids)  # a run of unknown characters is one piece


def test_best_fit_takes_the_fullest_bin():
    bins = packing.best_fit([(7,), (6,), (3,), (4,), (1,)], 10, lambda item: item[0])
    assert sorted(sorted(x[0] for x in b) for b in bins) == [[1], [3, 7], [4, 6]]


@pytest.mark.parametrize("kind", ["smallint", "decimal(9,2)", "date", "string"])
def test_packing_takes_keys_of_any_kind(spark, kind):
    rows = spark.range(40).selectExpr(
        f"case when id % 9 = 0 then null when '{kind}' = 'date' then cast(date_add(date'2020-01-01', cast(id as int)) as string) else cast(id as string) end as k",
        "if(id % 2 = 0, '', repeat('some words ', 5)) as text", "id as __deal",
    ).selectExpr(f"cast(k as {kind}) as doc_id", "text", "__deal")
    out = packing.pack(rows, tokenizer_path("word_bpe_49k.json"), capacity=64)
    assert out.count() == 40 and out.where("doc_id is null").count() == 5
    assert dict(out.dtypes)["doc_id"] == kind


def test_packing_is_gapless_and_holds_every_piece(edge_docs, edge_rows, no_docs, library):
    vocabulary = tokenizer_path("word_bpe_49k.json")
    found = packing.pack(edge_docs, vocabulary).collect()
    wanted = []
    for key, text, *_ in edge_rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            wanted.append((key, n, at, len(part), zlib.crc32(array.array("I", part).tobytes())))
    assert sorted(map(str, (tuple(r)[:5] for r in found))) == sorted(map(str, wanted))
    bins = defaultdict(list)
    for row in found:
        bins[row["sequence_id"]].append((row["offset"], row["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in found) // 2048) + 1
    assert packing.pack(no_docs, vocabulary).count() == 0

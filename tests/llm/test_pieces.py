import hashlib
import random

import pytest
import sentencepiece as spm

from parchmine.llm import pieces as P

TEXTS = [
    "", " ", "  ", "\n", "\n\n a", "a\n", "a \n b", "▁", "a▁b ▁ c", "héllo wörld  x", "日本語 text 🙂‍", "x" * 3000,
    "tab\tcr\r\nend;\r\n", "<s> </s> <unk> <0x0A>", "ﬁ Ⅷ ½   　y", "\x00nul\x00", "a  b   c    ", "ab " * 4000,
]


@pytest.fixture(scope="module")
def c():
    return P.PieceCodec(P.default_model())


def randomly():
    rng = random.Random(4)
    alphabet = ["a", "th", "e", " ", " ", "\n", "é", "▁", "1", "\t", "\r", "🙂", "日", ";", ".", "  ", "<0x41>"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(800)]


def test_ids_equal_the_library(c):
    assert c.plain
    sp = spm.SentencePieceProcessor(model_file=P.default_model())
    for t in TEXTS + randomly():
        assert c.encode(t) == sp.encode(t), t


def test_spans_cover_the_source(c):
    for t in TEXTS + randomly():
        spans, data = c.spans(t), t.encode()
        at = 0
        for i, a, b in spans:
            assert a == at and b >= a
            at = b
            if not c.is_byte[i]:
                assert c.bytes[i].decode().replace("▁", " ").endswith(data[a:b].decode().replace("▁", " "))
            else:
                assert c.bytes[i] == data[a:b]
        assert at == len(data)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_normalizer_equals_the_library(rule, squeeze):
    lib = spm.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto.FromString(lib.serialized_model_proto()).normalizer_spec
    ours = P.Normalizer(spec.precompiled_charsmap, True, squeeze, True)
    for t in TEXTS + randomly():
        out, align = ours(t)
        assert out.decode() == lib.normalize(t), (t, rule)
        assert len(align) == len(out) + 1 and align == sorted(align) and align[-1] <= len(t.encode())


def test_digests(spark, c):
    sp = spm.SentencePieceProcessor(model_file=P.default_model())
    rows = list(enumerate([None, *TEXTS, *randomly()[:50], TEXTS[-1]]))
    got = {r.doc_id: r for r in P.encode_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        ids = sp.encode(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
        assert got[i].covered_bytes == len((t or "").encode())
    spans = P.encode_spans(spark.createDataFrame(rows[:5], "doc_id long, text string")).collect()
    assert [[tuple(p) for p in r.pieces] for r in spans] == [c.spans(t) for _, t in rows[:5]]
    assert P.encode_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_alignment_of_all_bytes_equals_the_stepwise_one(c):
    for t in TEXTS + randomly():
        out, align = c.normalizer.aligned(t)
        assert (out, align.tolist()) == c.normalizer(t), t


@pytest.mark.parametrize("change", [lambda a: [*a[:-1], a[-1] - 1], lambda a: [*a[:8], *[x - 1 for x in a[8:12]], *a[12:]]])
def test_covered_bytes_come_from_the_alignment(change):
    c, t = P.PieceCodec(P.default_model()), "héllo wörld and more"
    assert c.digest(t)[3] == len(t.encode())

    class Wrong(P.Normalizer):
        def __call__(self, text):
            out, align = super().__call__(text)
            return out, change(align)

        def aligned(self, text):
            out, align = self(text)
            return out, P.np.array(align)

    c.normalizer.__class__ = Wrong
    assert c.digest(t)[3] < len(t.encode())

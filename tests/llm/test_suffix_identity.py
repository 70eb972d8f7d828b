"""Strings that sums of codes times powers, modulo 2 ** 64, cannot tell apart repeat nowhere."""

import hashlib

from trawl.llm import suffixes


def thue_morse(n, a, b):
    return "".join(b if i.bit_count() & 1 else a for i in range(n))


def test_texts_that_powers_modulo_two_to_the_64_confuse(spark):
    p, q = thue_morse(256, "!", "("), thue_morse(256, "(", "!")
    middle = "bhdxmvrqasjaahqwumiulxagtxngxoqybezrtiubdmdbptpedwpifbdrocfkoyrf"
    texts = [p + middle + q, q + middle + p]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(df).collect()}
    assert got == {i: (0, 0, hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(texts)}


def test_contexts_that_differ_have_other_names():
    import numpy as np

    a, b = (np.frombuffer(thue_morse(512, x, y).encode(), np.uint8) for x, y in (("a", "c"), ("c", "a")))
    at = np.array([0]), np.array([0]), np.array([112])
    one, two = suffixes._context(a, *at, 400), suffixes._context(b, *at, 400)
    assert (one[0] != two[0]).all() and (one[1] != two[1]).all()
    assert (suffixes._context(a.copy(), *at, 400)[0] == one[0]).all()

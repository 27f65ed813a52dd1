import random

import pytest

from tests.conftest import SF_SMALL  # noqa: F401


def made_up(rng, n, letters="abcdefghijklmnop", size=6):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, size))) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_texts():
    """Texts with every awkward shape: null, empty, blank, tiny, marks only, long, repeated, near copies, shared passages."""
    rng = random.Random(11)
    base, passage = made_up(rng, 160), made_up(rng, 70)
    near = [list(base) for _ in range(12)]
    for k, w in enumerate(near):
        for i in rng.sample(range(len(w)), k % 4):
            w[i] = f"x{k}{i}"
    texts = [None, "", "   \n\t ", "word", "$$$ *** ###", "Éa ÉA éa", "a b c d e", "a b c d e", "1 2 3"]
    texts += [" ".join(w) for w in near]
    texts += [" ".join(made_up(rng, 40) + passage + made_up(rng, 30)) for _ in range(3)]
    texts += [" ".join(made_up(rng, 6000)), "na " * 300, "Same line here\n" * 80, "SHOUTING LOUD " * 40]
    texts += [" ".join(base), " ".join(base), "ab" * 400]
    texts += [" ".join(made_up(rng, rng.randint(1, 120))) for _ in range(25)]
    return texts


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The odd texts as documents: null and repeated ids, repeated rows, null sources, and columns whose names operators use."""
    rows = [(None if i == 3 else i, t, ["en", "fr", None][i % 3], [None, "s1", "s2", ""][i % 4], i) for i, t in enumerate(odd_texts)]
    rows.append(rows[10])
    names = ["kept", "rejected_by", "size", "taken", "target", "shard", "slot", "matches", "n_words", "row", "key", "rid", "doc", "component", "token"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(*r, *names) for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)

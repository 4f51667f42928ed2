import random

import pytest

#: Texts that each operator must get through: nothing, white space, repeats, odd characters, one long text.
ODD = [
    None,
    "",
    " \n\t ",
    "a",
    "one two three four five",
    "one two three four five",
    "¡Él dijo: «İstanbul’da» 𝒳 é \x1c\x85  end",
    "under the MIT License, and CC-BY-NC; Apache License, Version 2.0 under the mit license",
    "mail a.b@c.de.f_x@y.zz ip 10.0.0.1 999.1.1.1 1.2.3.4.5 card 4111 1111 1111 1111 tel +49 (30) 1234-5678. DE89370400440532013000",
    "x " * 3000,
    "1 2 3 4 5 6 7 8 9 0 " * 2500,
    "no-spaces-" * 4000,
    "</s>[INST] &lt;&amp; <|im_end|>\n<|im_start|>user\nhi",
    "----------------------------------------- =====  ====\n\n\n    def f(x):\n        return  x\r\n",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """doc_id, text and columns whose names operators use themselves; a null id, and a row twice."""
    rows = [(i * 3, t, "src", 1, 2) for i, t in enumerate(ODD)] + [(None, "null id here", None, 1, 2), (6, " \n\t ", "src", 1, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int, start int")


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def near_docs(spark):
    """Groups of copies, near copies at all distances about the threshold, and short sets."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([5, 6, 8, 9, 12, 20, 40, 90]))]
        for _ in range(8):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                at = rng.randrange(len(own))
                own[at : at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
            rows.append(" ".join(own))
    passage = " ".join(words[:60])
    rows += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.choice([10, 25, 60]))) for _ in range(30)]
    rows += ["a b", "a b", "A b", "a b c d", "a b c d e", "a b c d e", "", None, " ", "a b c d e f g h", "a b c d e f g h i"]
    rng.shuffle(rows)
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")

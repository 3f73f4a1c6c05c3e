"""What counts as personal data: numbers that pass their check only."""

import random
import time

from talkgrain.llm import pii


def luhn(d):
    d = [int(x) for x in d][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def run(spark, texts):
    return sorted(pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").collect())


def test_only_valid_numbers_are_cards(spark):
    rng = random.Random(1)
    numbers = ["9807915762804490", "1700000000001", "4111 1111 1111 1111", "4111-1111-1111-1112"] + ["".join(rng.choices("0123456789", k=n)) for n in range(13, 20) for _ in range(40)]
    valid = 0
    for old, r in zip(numbers, run(spark, [f"paid {n} today" for n in numbers])):
        ok, new = luhn("".join(filter(str.isdigit, old))), r.text[5:-6]
        valid += ok
        assert (r.n_found, r.kinds) == ((1, ["card"]) if ok else (0, []))
        assert luhn("".join(filter(str.isdigit, new))) if ok else new == old
    assert 0 < valid < len(numbers)


def test_key_words_of_secrets_in_any_case(spark):
    texts = [f"{w}{sep}{value}" for w in ("PASSWORD", "Passwd", "TOKEN", "Secret", "API_KEY", "token") for sep, value in (("=", "abcdefghijklmnop"), (' = "', 'ABCDEFGHIJKL_MNOP"'))]
    for text, r in zip(texts, run(spark, texts)):
        assert (r.n_found, r.kinds) == (1, ["secret"]) and "mnop" not in r.text.lower(), text


def test_numbers_are_permuted_one_to_one(spark):
    """All check digits of some numbers: the valid ones get different valid pseudonyms, the others stay."""
    rng = random.Random(12)
    bodies = {"".join(rng.choice("0123456789") for _ in range(15)) for _ in range(400)}
    numbers = [b + str(c) for b in sorted(bodies) for c in range(10)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "doc_id int, text string")
    got = {numbers[r.doc_id]: r.text for r in pii.pseudonymise(df, "k").collect()}
    for n, new in got.items():
        assert (luhn(new) and len(new) == 16) if luhn(n) else new == n
    changed = [new for n, new in got.items() if luhn(n)]
    assert len(set(changed)) == len(bodies)


def test_a_phone_is_linked_however_it_is_written(spark):
    forms = ["+1 988 555 2485", "+1 (988) 555-2485", "+19885552485", "(988) 555-2485", "988-555-2485"]
    rows = [r.text for r in sorted(pii.pseudonymise(spark.createDataFrame(list(enumerate(forms)), "doc_id int, text string"), "k").collect())]
    digits = ["".join(c for c in r if c.isdigit()) for r in rows]
    assert len({d[-10:] for d in digits}) == 1 and all(d.startswith("1") for d in digits[:3]) and digits[0][-10:] != "9885552485"
    other = pii.pseudonymise(spark.createDataFrame([(1, "+4420794609581")], "doc_id int, text string"), "k").first().text
    assert other.startswith("+44") and len(other) == 14 and other != "+4420794609581"


def test_long_texts_take_linear_time(spark):
    runs = ["a" * 1_000_000 + "@", "a." * 500_000 + "@", "a@b" + ".c" * 500_000, "1." * 500_000, "token=" + "x" * 1_000_000, "1-" * 500_000]
    began = time.time()
    got = pii.pseudonymise(spark.createDataFrame(list(enumerate(runs)), "doc_id int, text string"), "k").collect()
    assert len(got) == 6 and time.time() - began < 60


def test_clashing_columns(spark):
    df = spark.createDataFrame([(None, "call 988-555-2485 now", 1, 2, 3, "x")], "doc_id int, text string, _v int, _f int, n_found int, kinds string")
    out = pii.pseudonymise(df, "k")
    assert out.columns == ["doc_id", "text", "_v", "_f", "n_found", "kinds"]
    r = out.first()
    assert (r._v, r._f, r.n_found, r.kinds) == (1, 2, 1, ["phone"]) and "988-555-2485" not in r.text

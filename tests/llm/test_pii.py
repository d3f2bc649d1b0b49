import datetime
import hashlib
import random
import re

from pyspark.sql import functions as F

from plumbline.llm import pii

KEY = "k"


def shuffled(value, kind, classes=pii.CLASSES):
    """The Feistel network over a string, step by step."""
    half = len(value) // 2
    a, b = value[:half], value[half:]
    for r in range(1, pii.ROUNDS + 1):
        h = hashlib.sha512(f"{KEY}|{kind}|{r}|{b}".encode()).hexdigest()
        out = ""
        for i, c in enumerate(a):
            letters = next((x for x in classes if c in x), None)
            out += letters[(letters.index(c) + int(h[2 * i : 2 * i + 2], 16)) % len(letters)] if letters else c
        a, b = b, out
    return a + b


def moved(n, a, b, kind):
    x, y = divmod(n, b)
    f = lambda side, r, v: int(hashlib.sha512(f"{KEY}|{kind}|{side}|{r}|{v}".encode()).hexdigest()[:14], 16)
    for r in range(1, pii.ROUNDS // 2 + 1):
        x = (x + f("x", r, y)) % a
        y = (y + f("y", r, x)) % b
    return x * b + y


def luhn(digits):
    d = [int(c) for c in digits]
    return sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])


def with_check_digit(payload):
    return payload + next(c for c in "0123456789" if luhn(payload + c) % 10 == 0)


def run(spark, *texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_email string")
    return [r.asDict() for r in pii.pseudonymised(df, KEY).orderBy("doc_id").collect()]


def test_against_the_plain_network(spark):
    rnd = random.Random(5)
    values, want = [], []
    for _ in range(40):
        local = "".join(rnd.choice("abzXY09.éß_") for _ in range(rnd.randrange(1, 20))).strip(".") or "q"
        values.append(f"{local}@mail3.example.com")
        want.append(f"{shuffled(local, 'email')}@mail3.example.com")
        card = with_check_digit("".join(rnd.choice("0123456789") for _ in range(15)))
        values.append(card)
        want.append(with_check_digit(shuffled(card[:-1], "card")))
        octets = [rnd.randrange(256) for _ in range(4)]
        n = moved(int.from_bytes(bytes(octets), "big"), 65536, 65536, "ip")
        values.append(".".join(map(str, octets)))
        want.append(".".join(map(str, n.to_bytes(4, "big"))))
        day = datetime.date(1900, 1, 1) + datetime.timedelta(days=rnd.randrange(72900))
        new = datetime.date(1900, 1, 1) + datetime.timedelta(days=moved((day - datetime.date(1900, 1, 1)).days, 270, 270, "date"))
        form = rnd.choice(["%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y"])
        values.append(day.strftime(form))
        want.append(new.strftime(form))
        token = "".join(rnd.choice("0123456789abcdef") for _ in range(40))
        values.append(f'token = "{token}"')
        want.append(f'token = "{shuffled(token, "secret", pii.HEX_LOWER)}"')
        area, group, serial = rnd.choice([1, 665, 667, 899]), rnd.randrange(1, 100), rnd.randrange(1, 10000)
        n = moved((area - (2 if area > 666 else 1)) * 99 * 9999 + (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn")
        new_area, rest = divmod(n, 99 * 9999)
        values.append(f"{area:03d}-{group:02d}-{serial:04d}")
        want.append(f"{new_area + 1 + (new_area + 1 >= 666):03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}")
        phone = "".join(rnd.choice("0123456789") for _ in range(10))
        values.append(f"+1 ({phone[:3]}) {phone[3:6]}-{phone[6:]}")
        new = shuffled(phone, "phone")
        want.append(f"+1 ({new[:3]}) {new[3:6]}-{new[6:]}")
    got = run(spark, *[f"eins {v}, zwei" for v in values])
    assert [r["text"] for r in got] == [f"eins {w}, zwei" for w in want]
    assert all(r["n_private"] == 1 for r in got)


def test_formats_stay_valid(spark):
    got = run(spark, "4111 1111 1111 1111 / DE89 3704 0044 0532 0130 00 / GB82WEST12345698765432 / 1.2.3.4 / 123-45-6789")[0]
    card, iban, british, ip, ssn = got["text"].split(" / ")
    assert luhn(card.replace(" ", "")) % 10 == 0 and re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", card)
    for value in (iban, british):
        bare = value.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
    assert re.fullmatch(r"DE\d\d( \d{4}){4} \d\d", iban) and re.fullmatch(r"GB\d\d[A-Z]{4}\d{14}", british)
    assert all(0 <= int(o) < 256 for o in ip.split(".")) and not re.search("^(000|666|9)|-00-|-0000$", ssn)
    assert got["n_private"] == 5


HIDDEN = {
    "ES9121000418450200051332 BIC": ("iban", 1), "AT61 1904 3002 3457 3201 EUR": ("iban", 1), "AT611904300234573201 2024": ("iban", 1),
    "AB12 CDEF GHIJ 4111 1111 1111 1111": ("card", 1), "ES12 CDEF GHIJ 4111 1111 1111 1111": ("card", 1), "2024 4111 1111 1111 1111": ("card", 1),
    "ES9121000418450200051332 PAID": ("iban", 1), "ES9121000418450200051332 IS": ("iban", 1),
    "2020-01-01/2020-02-01": ("date", 2), "99/99/2020 then 01/02/2020/03/04/2020": ("date", 2), "+49 30 1234 5678 2024 1234 and 1.2.3.4": ("phone", 1),
    "AB12 CDEF GHIJ bob@x.org 999.1.1.1 4111111111111111": ("card", 1),
}


def test_failed_candidates_hide_nothing(spark):
    got = run(spark, *HIDDEN)
    assert [(t, r[f"n_{kind}"]) for r, (t, (kind, _)) in zip(got, HIDDEN.items(), strict=True)] == [(t, n) for t, (_, n) in HIDDEN.items()]
    alone = run(spark, "ES9121000418450200051332", "AT61 1904 3002 3457 3201", "4111 1111 1111 1111", "2020-01-01", "2020-02-01")
    spanish, austrian, card, first, second = (r["text"] for r in alone)
    texts = [r["text"] for r in got]
    assert texts[0] == spanish + " BIC" and texts[1] == austrian + " EUR" and texts[2] == austrian.replace(" ", "") + " 2024"
    assert texts[3] == "AB12 CDEF GHIJ " + card and texts[4] == "ES12 CDEF GHIJ " + card and texts[5] == "2024 " + card
    assert texts[8] == f"{first}/{second}" and got[10]["n_ip"] == 1 and got[11]["n_email"] == 1


def test_no_value_stays_in_clear(spark):
    """Generated values of known places in every context, from 16 to 4,000 characters."""
    rnd = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    token = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    contexts = ["{}", "see {}\nNext", "{} PAID", "{} IS due", "({}), then", "x {}, y", '{{"v": "{}"}}', "Mr {} BIC AND 2024"]
    rows, values = [], []
    for n in (16, 17, 127, 128, 129, 200, 300, 4000):
        for label in ("token = {}", "password: '{}'", '"api_key": "{}"', '\\"secret\\": \\"{}\\"', "AKIA{}", "ghp_{}", "sk-{}"):
            values.append(token(n))
            rows.append(rnd.choice(contexts).format(label.format(values[-1])))
    for n in (1, 5, 64, 65, 128, 129, 400):
        values.append(token(n) + "7")
        rows.append(rnd.choice(contexts).format(f"{values[-1]}@a.b.c.d.e.f.g.h.i.mail.example.org"))
    for size, countries in pii.IBAN_LENGTHS.items():
        for country in countries.split():
            account = "".join(rnd.choice("0123456789") for _ in range(size - 4))
            check = 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97
            iban = f"{country}{check:02d}{account}"
            values.append(iban[4:])
            rows.append(rnd.choice(contexts).format(iban))
    for phone in ("555-234-7788", "(555) 234-7788", "555.234.7788", "01 23 45 67 89", "+49 30 1234567"):
        for context in contexts:
            values.append(phone)
            rows.append(context.format(phone))
    for text, value, r in zip(rows, values, run(spark, *rows), strict=True):
        assert r["n_private"] >= 1 and value not in r["text"] and len(r["text"]) == len(text), text
        if len(value) > 128:  # nor any long part of it
            assert not any(value[i : i + 20] in r["text"] for i in range(0, len(value) - 20))


def test_secrets_of_any_name_and_alphabet(spark):
    """Names of environments, web tokens, base64, wide blanks and keys known by their beginnings: no part stays in clear."""
    rnd = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    token = lambda n, more="": "".join(rnd.choice(letters + more) for _ in range(n - 1)) + "7"
    web = lambda: f"eyJ{token(33)}.eyJ{token(80, '-_')}.{token(43, '-_')}"
    labels = [
        "DB_PASSWORD={}", "client_secret: {}", "AWS_SECRET_ACCESS_KEY={}", "my_password={}", "password :      {}", "export GITHUB_TOKEN='{}'", "secret_key = {}",
        "PRIVATE-KEY:{}", "pwd={}", "\"refresh_token\" : \"{}\"", "passphrase:\t\t{}",
    ]
    rows, values = [], []
    for label in labels:
        for value in (token(20), token(64, "/+") + "==", web(), token(40, "._~-")):
            rows.append(f"see {label.format(value)}\nthen more")
            values.append(value)
    for known in ("github_pat_{}", "glpat-{}", "Authorization: Bearer {}", "bearer   {}"):
        values.append(token(40))
        rows.append(f"x {known.format(values[-1])} y")
    values.append(web())
    rows.append(f"cookie {values[-1]};")
    for text, value, r in zip(rows, values, run(spark, *rows), strict=True):
        assert r["n_private"] == r["n_secret"] == 1 and len(r["text"]) == len(text), (text, r["text"])
        assert not any(value[i : i + 8] in r["text"] for i in range(3, len(value) - 8)), (text, r["text"])


def test_links_hold_across_documents_and_layouts(spark):
    a, b, c = run(spark, "x 4111-1111-1111-1111 y", "4111111111111111 and bob.1@x.org", "bob.1@x.org bob.1@x.org +1 (017) 555-7713 +1 017 555 7713")
    card = a["text"].split()[1].replace("-", "")
    assert b["text"].split()[0] == card
    mails = [m for r in (b, c) for m in re.findall(r"\S+@\S+", r["text"])]
    assert len(set(mails)) == 1 and mails[0] != "bob.1@x.org" and mails[0].endswith("@x.org")
    phones = re.findall(r"\+1[^+]*", c["text"])
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1


def test_permutations_are_one_to_one(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("s"), F.col("id").alias("n"))
    got = df.select(pii.permuted_text(F.col("s"), KEY, "t").alias("s"), pii.permuted_number(F.col("n"), 25, 40, KEY, "t").alias("n")).agg(F.countDistinct("s"), F.countDistinct("n"), F.max("n")).first()
    assert tuple(got) == (1000, 1000, 999)


CLEAN = [
    None, "", "plain words", "4111111111111112", "version 4.0 of 300.1.1.1 and 1.2.3.4.5", "31.02.2020 and 2020-13-01", "000-12-3456 666-12-3456", "GB82WEST12345698765433",
    "a@b", "12345678901234567890", "token of thanks", "the bearer internationalisation", "mytoken: abcdefghijklmnopqrstuv", "eyJust a word", "1,234,567", "@ @@ 5 key", "9" * 5000, "é" * 3000 + "@",
]


def test_clean_texts_stay(spark):
    got = run(spark, *CLEAN)
    assert [r["text"] for r in got] == CLEAN and not any(r["n_private"] for r in got)


def test_long_texts_repeated_rows_nulls_and_no_rows(spark):
    body = " ".join(f"w{i} user{i}@x.org" for i in range(3000))
    df = spark.createDataFrame([(1, body), (1, body), (None, "1.2.3.4")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_private"], r["n_email"], r["n_ip"]) for r in pii.pseudonymised(df, KEY).collect())
    assert got == [(0, 1, 0, 1), (1, 3000, 3000, 0), (1, 3000, 3000, 0)]
    assert pii.pseudonymised(df.limit(0), KEY).count() == 0

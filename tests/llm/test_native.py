import datetime
import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from medialedger.llm import chat, pseudonyms, queries, sharding
from tests.llm.helpers import documents


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (i % 2 + 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_feistel_is_a_permutation(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("n"))
    out = [r[0] for r in df.select(pseudonyms.permute_digits(F.col("n"), "k", "t")).collect()]
    assert len(set(out)) == 1000 and all(re.fullmatch(r"\d{3}", x) for x in out)
    for n in (2, 3, 5):
        df = spark.range(10 ** (n - 1), 10**n).select(F.col("id").cast("string").alias("n"))
        out = {r[0] for r in df.select(pseudonyms.permute_digits(F.col("n"), "k", "t", first_nonzero=True)).collect()}
        assert out == {str(i) for i in range(10 ** (n - 1), 10**n)}
    days = spark.range(146097).select(F.date_format(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")), "dd.MM.yyyy").alias("d"))
    assert days.select(pseudonyms._date(F.col("d"), "k").alias("p")).distinct().count() == 146097


def test_numbers_stay_valid_and_apart(spark):
    valid = r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$"
    # Steps that share no factor with a domain's size pass through all of it.
    at = (F.col("id") * 7919) % (898 * 99 * 9999)
    area, rest = F.floor(at / (99 * 9999)), at % (99 * 9999)
    ssn = F.format_string("%03d-%02d-%04d", F.when(area >= 665, area + 2).otherwise(area + 1), F.floor(rest / 9999) + 1, rest % 9999 + 1)
    df = spark.range(60_000).select(ssn.alias("v"))
    assert df.where(~F.col("v").rlike(valid)).isEmpty()
    out = df.select(pseudonyms._ssn(F.col("v"), "k").alias("p"))
    assert out.where(~F.col("p").rlike(valid)).isEmpty() and out.distinct().count() == 60_000
    odd = [f"{a}-12-3456" for a in ("000", "666", "900", "999")] + ["123-00-4567", "123-45-0000"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in odd], "v string").select(pseudonyms._ssn(F.col("v"), "k")).collect()] == odd

    number = F.lpad(((F.col("id") * 99_991) % 10**9).cast("string"), 9, "0")
    df = spark.range(20_000).select(F.concat(F.lit("030 "), F.substring(number, 1, 7)).alias("a"), F.concat(F.lit("+49 3"), number).alias("b"), F.concat(F.lit("("), (F.col("id") % 800 + 200).cast("string"), F.lit(") 2"), F.substring(number, 2, 2), F.lit("-"), F.substring(number, 4, 4)).alias("c")).distinct()
    out = df.select(*[pseudonyms._phone(F.col(c), "k").alias(c) for c in "abc"])
    assert out.where(~F.col("a").rlike(r"^0[1-9]\d \d{7}$") | ~F.col("b").rlike(r"^\+49 [1-9]\d{9}$") | ~F.col("c").rlike(r"^\([2-9]\d\d\) [2-9]\d\d-\d{4}$")).isEmpty()
    for c in "abc":
        assert out.select(c).distinct().count() == df.select(c).distinct().count()


def brute_feistel(left, right, a, b, key, tag):
    for i in range(8):
        noise = lambda half: int(hashlib.sha256(f"{key}|{tag}|{i}|{half}".encode()).hexdigest()[:15], 16)  # noqa: E731, B023
        if i % 2 == 0:
            left = (left + noise(right)) % a
        else:
            right = (right + noise(left)) % b
    return left, right


def brute_digits(number, key, kind, first_nonzero=False):
    half = len(number) // 2
    low = 10 ** (half - 1) if first_nonzero else 0
    sides = brute_feistel(int(number[:half]) - low, int(number[half:]), 10**half - low, 10 ** (len(number) - half), key, f"{kind}{len(number)}")
    return str(sides[0] + low).zfill(half) + str(sides[1]).zfill(len(number) - half)


def brute_american(number, key):
    area, exchange, line = int(number[:3]), int(number[3:6]), int(number[6:])
    (low_a, size_a), (low_e, size_e) = ((0, 200) if x < 200 else (200, 800) for x in (area, exchange))
    left, right = brute_feistel(area - low_a, (exchange - low_e) * 10**4 + line, size_a, size_e * 10**4, key, f"phone{size_a}/{size_e}")
    return f"{left + low_a:03d}{right + low_e * 10**4:07d}"


def brute_refill(shape, number):
    rest = iter(number)
    return "".join(next(rest) if "0" <= c <= "9" else c for c in shape)


def iban_rest(plain):
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def brute_date(value, key):
    for layout in ("%d/%m/%Y", "%m/%d/%Y", "%d.%m.%Y", "%b %d, %Y", "%B %d, %Y", "%d %b %Y", "%d %B %Y", "%Y-%m-%d"):
        try:
            day = (datetime.datetime.strptime(value, layout).date() - datetime.date(1800, 1, 1)).days
        except ValueError:
            continue
        if not 0 <= day < 189 * 773:
            return value
        left, right = brute_feistel(day // 773, day % 773, 189, 773, key, "date")
        shown = (datetime.date(1800, 1, 1) + datetime.timedelta(left * 773 + right)).strftime(layout)
        parts = re.split(r"[/.]", value)
        keeps_zeros = "-" in value or len(parts) == 3 and len(parts[0]) == len(parts[1]) == 2
        return shown if keeps_zeros else re.sub(r"\b0(\d)\b", r"\1", shown)
    return value


def brute_pseudonym(value, key):
    kind = next(k for k, p in pseudonyms.KINDS.items() if re.fullmatch(p, value))
    plain = re.sub(r"\D", "", value)
    sha = lambda *x: hashlib.sha256("|".join(x).encode()).hexdigest()
    if kind == "email":
        return f"user-{sha(key, 'email', value.lower())[:16]}@example.invalid"
    if kind == "secret":
        digest = sha(key, "secret", value.lower())[: len(value)]
        return digest.upper() if value == value.upper() else digest
    if kind == "token":
        prefix = re.match(r"A[KS]IA|[a-z]+[_-]", value)[0]
        digest = (sha(key, "token", value) + sha(key, "token, second part", value))[: len(value) - len(prefix)]
        return prefix + (digest.upper() if value[0] == "A" else digest)
    if kind == "iban":
        joined = value.replace(" ", "")
        body = re.sub(r"\D", "", joined[4:])
        if iban_rest(joined) != 1 or len(body) < 2:
            return value
        moved = brute_refill(joined[4:], brute_digits(body, key, "iban"))
        check = f"{98 - iban_rest(joined[:2] + '00' + moved):02d}"
        return brute_refill(value, check + re.sub(r"\D", "", moved))
    if kind == "date":
        return brute_date(value, key)
    if kind == "ip":
        p = [int(x) for x in value.split(".")]
        left, right = brute_feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, key, "ip")
        return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    if kind == "phone":
        kept = 0 if value[0] != "+" else 1 if plain[0] in "17" else 2 if plain[:2] in pseudonyms.CODES_OF_TWO else 3
        american = plain[0] == "1" if value[0] == "+" else not re.match(r"0\d{2,4}[ /]", value)
        head, rest = plain[:kept], plain[kept:]
        if american and len(rest) == 10:
            return brute_refill(value, head + brute_american(rest, key))
        tail = rest.lstrip("0")
        return brute_refill(value, head + rest[: len(rest) - len(tail)] + (tail if len(tail) < 2 else brute_digits(tail, key, "phone", True)))
    if kind == "ssn":
        if not re.match(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)", value):
            return value
        area, group, serial = map(int, value.split("-"))
        left, right = brute_feistel(area - 2 if area > 666 else area - 1, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
        return f"{left + 2 if left >= 665 else left + 1:03d}-{right // 9999 + 1:02d}-{right % 9999 + 1:04d}"
    if not luhn(plain):
        return value
    body = brute_digits(plain[:-1], key, "card")
    return brute_refill(value, next(body + str(c) for c in range(10) if luhn(body + str(c))))


def test_equals_brute_force(spark):
    rng = random.Random(8)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    made = [
        lambda: f"a.b{number(2)}@mail{number(1)}.example.com", lambda: hashlib.sha1(number(5).encode()).hexdigest(), lambda: hashlib.md5(number(5).encode()).hexdigest().upper(),
        lambda: "AKIA" + hashlib.md5(number(5).encode()).hexdigest()[:16].upper(), lambda: "sk-" + number(24), lambda: "DE89 3704 0044 0532 0130 00", lambda: "GB82WEST12345698765432",
        lambda: "FR1420041010050500013M02606", lambda: f"{number(4)}-{number(2)}-{number(2)}", lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1700, 2300)}",
        lambda: f"{rng.randint(1, 31):02d}/{rng.randint(1, 31):02d}/{rng.randint(1800, 2199)}", lambda: f"{rng.choice(['Jan', 'May', 'December'])} {rng.randint(1, 31)}, 2001",
        lambda: f"{rng.randint(1, 28)} March 1999", lambda: ".".join(str(rng.randint(0, 280)) for _ in range(4)), lambda: f"+1 ({number(3)}) {number(3)}-{number(4)}",
        lambda: f"+49 30 {number(8)}", lambda: f"+4930{number(8)}", lambda: f"{number(3)}-{number(3)}-{number(4)}", lambda: f"030 {number(7)}", lambda: f"{number(3)}-{number(2)}-{number(4)}",
        lambda: number(16), lambda: f"{number(4)} {number(4)} {number(4)} {number(4)}", lambda: "4111-1111-1111-1111", lambda: number(19), lambda: number(rng.randint(1, 9)),
    ]
    texts = []
    for i in range(400):
        parts = [rng.choice(["word", "é!", "\n", "x", "", pseudonyms._MARK if i % 40 == 0 else ","]) for _ in range(6)]
        texts.append(" ".join(x for p in parts for x in (p, rng.choice(made)())))
    docs = documents(spark, texts).withColumns({"parts": F.lit(1), "n_pseudonyms": F.lit("clash")})
    rows = pseudonyms.pseudonymize(docs, "k").orderBy("doc_id").collect()
    whole = re.compile(pseudonyms.PATTERN, re.ASCII)
    for t, r in zip(texts, rows, strict=True):
        found = [m[0] for m in whole.finditer(t)]
        assert r["text"] == whole.sub(lambda m: brute_pseudonym(m[0], "k"), t), t
        assert r["n_pseudonyms"] == sum(brute_pseudonym(v, "k") != v for v in found)


def test_one_number_written_in_ways_and_long_texts(spark):
    texts = ["+49 30 12345678", "+493012345678", "+49 (30) 1234-5678", "+1 555 123 4567", "(555) 123-4567", "x@" + "a." * 500_000 + "com", "a" * 10**6 + "@b.com 1"]
    texts += ["1" * 10**6, "+1 " * 300_000, "1.1." * 250_000, "a@" * 400_000, "4111 " * 200_000, "AB12" + " ABCD" * 200_000]
    rows = [r["text"] for r in pseudonyms.pseudonymize(documents(spark, texts), "k").orderBy("doc_id").collect()]
    plain = [re.sub(r"\D", "", t) for t in rows[:5]]
    assert plain[0] == plain[1] == plain[2] != re.sub(r"\D", "", texts[0]) and plain[3] == "1" + plain[4]
    assert all(re.fullmatch(r"user-[0-9a-f]{16}@example.invalid( 1)?", t) for t in rows[5:7]) and rows[7:9] == texts[7:9]


def test_texts(spark):
    card, bad = "4111 1111 1111 1111", "4111111111111112"
    t = f"Ann é {card}, {bad}! x.30@mail1.example.com +1 (017) 555-7713### 217.75.41.129 300.1.1.1 2024-02-29 2023-02-30 31/12/1999 078-05-1120 4.0. 3.\n" + 'token = "ffc3105535f423f352535e4ac53b5fefe076ac6d"!! 4111111111111111'
    rows = pseudonyms.pseudonymize(documents(spark, [t, "other 4111-1111-1111-1111", None, "", "plain @ 12"]), "secret").orderBy("doc_id").collect()
    new = rows[0]["text"]
    shape = lambda s: re.sub(r"[0-9]", "9", re.sub(r"[\w.-]+@[\w.]+", "@", re.sub(r"[0-9a-f]{40}", "hex", s)))
    assert re.sub(r"9+\.9+\.9+\.9+", "ip", shape(new)) == re.sub(r"9+\.9+\.9+\.9+", "ip", shape(t))
    for gone in (card, "x.30@mail1", "555-7713", "217.75.41.129", "2024-02-29", "31/12/1999", "078-05-1120", "ffc31055"):
        assert gone not in new, gone
    for kept in (bad, "300.1.1.1", "2023-02-30", "4.0. 3.\n", "+1 ("):
        assert kept in new
    cards = re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", new + rows[1]["text"]) + [new[-16:]]
    assert len({re.sub(r"\D", "", c) for c in cards}) == 1 and luhn(re.sub(r"\D", "", cards[0]))
    assert [r["n_pseudonyms"] for r in rows] == [9, 1, 0, 0, 0]
    assert [r["text"] for r in rows[2:]] == [None, "", "plain @ 12"]
    assert pseudonyms.pseudonymize(documents(spark, []), "k").collect() == []


def test_shards(spark, tmp_path):
    texts = [None, "", "same", "same", *("t%d é" % i for i in range(200)), "long " * 4000, *["copy"] * 3000]
    ids = [1, 1, *range(2, 205), *[7] * 3000]
    docs = documents(spark, texts, ids=ids)
    got = []
    for k, split in enumerate((docs.repartition(3), docs.orderBy(F.rand(1)).repartition(5, "text"))):
        out = sharding.shuffled_shards(split, f"file://{tmp_path}/a{k}", 8, 1, 2048)
        rows = out.collect()
        assert out.columns == [*docs.columns, "shard", "slot"]
        assert sorted((r["doc_id"], r["text"] or "") for r in rows) == sorted((i, t or "") for i, t in zip(ids, texts, strict=True))
        sizes = []
        for s in range(8):
            slots = sorted(r["slot"] for r in rows if r["shard"] == s)
            assert slots == list(range(len(slots)))
            sizes.append(len(slots))
        assert max(sizes) - min(sizes) <= 1
        got.append(sorted((r["slot"], r["shard"], r["doc_id"], r["text"] or "") for r in rows))
    assert got[0] == got[1]  # one seed, one order, however the table is split
    order = [r[2] for r in got[0] if r[3] != "copy"]
    assert order != sorted(order) and abs(sum(a < b for a, b in zip(order, order[1:], strict=False)) - 102) < 40
    # Copies are dealt over all shards and places as other rows are.
    assert max(sum(r[1] == s and r[3] == "copy" for r in got[0]) for s in range(8)) < 500
    assert sharding.shuffled_shards(documents(spark, []), f"file://{tmp_path}/b").collect() == []


def test_fisher_yates_equals_brute_force(spark):
    rows = spark.range(60).select((F.col("id") + 1).cast("int").alias("n"), F.xxhash64("id").alias("seed"))
    draws = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.pmod(F.xxhash64("seed", i), i + 1))
    for r in rows.select("n", sharding.fisher_yates(F.col("n"), F.col("seed")).alias("got"), draws.alias("draws")).collect():
        a = list(range(r["n"]))
        for i in range(r["n"] - 1, 0, -1):
            j = r["draws"][i]
            a[i], a[j] = a[j], a[i]
        assert r["got"] == a


def test_chat_round_trip(spark, tmp_path):
    rng = random.Random(1)
    bits = ["</s>", "[INST]", "<|end|>", "<|", "<\\|", "\\", "<", "|", "é", "\n", "a", "<|text|>", "$1", "[/INST]", "\\\\"]
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 7)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "<|x\n", None]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))])))
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df.withColumn("turns", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in queries.op8_chat_formatting(spark, str(tmp_path)).collect()}
    assert set(got) == {-7, *range(40)}
    for conv in range(40):
        mine = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        replies = "".join(t for role, t in mine if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(mine), sha("".join(f"{a}\n{b}\n" for a, b in mine)), len(replies), sha(replies))
    examples = chat.expand(df).where("conv_id = 3").count()
    mine = [r[2] for r in rows if r[0] == 3]
    assert examples == mine.count("assistant") + (mine[-1] != "assistant")


def test_crc(spark, tmp_path):
    docs = documents(spark, ["é", None])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in queries.op2_two_pass_shuffle(spark, str(tmp_path)).collect()}
    assert (rows[0]["size"], rows[0]["text_crc32"]) == (3, zlib.crc32("é".encode()))
    assert (rows[1]["size"], rows[1]["text_crc32"]) == (1, 0)


def test_odd_conversations(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    rows = [(None, 1, "user", "a"), (None, 2, "assistant", "b"), (5, 1, "user", "x"), (5, 1, "assistant", "y"), (5, 1, "assistant", "y"), (6, None, None, None)]
    df = spark.createDataFrame(rows, schema).withColumns({"shown": F.lit(1), "example": F.lit("clash")})
    got = sorted(((r["conv_id"] or -1, r["example"], r["formatted"], r["loss_start"], r["loss_length"]) for r in chat.expand(df).collect()), key=str)
    turn = lambda role, text: f"<|start|>{role}<|text|>{text}<|end|>"
    want = [
        (-1, 2, turn("user", "a") + turn("assistant", "b"), len(turn("user", "a")) + len("<|start|>assistant<|text|>"), 1),
        (5, 1, turn("assistant", "y"), 26, 1), (5, 2, turn("assistant", "y") * 2, len(turn("assistant", "y")) + 26, 1),
        (5, 3, turn("assistant", "y") * 2 + turn("user", "x"), None, 0), (6, 1, turn("", ""), None, 0),
    ]
    assert got == sorted(want, key=str)
    assert chat.expand(df.limit(0)).collect() == []

import hashlib
import itertools
import random
import re
import zlib

from barlight.llm import queries, repair
from pyspark.sql import functions as F

ROWS = "conv_id bigint, turn bigint, role string, text string, position int, fault string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        kept = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else "" if kept[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def search(rows, marks):
    """Least (cost, audit, lines) over all strings of edits, extended edit by edit; a state is what has been put out so far."""
    best = {"": (0, "", ())}
    for (_, _, role, text), mark in [*zip(rows, marks, strict=True), ((None,) * 4, None)]:
        for _ in range(4):  # inserts, some in a row
            for out, (cost, audit, lines) in list(best.items()):
                for new in ("user", "assistant"):
                    step(best, out + new[0], (cost + 5, audit + "I", (*lines, new + ":")))
        if role is None:
            break
        after = {}
        for out, (cost, audit, lines) in best.items():
            step(after, out, (cost + 2, audit + "D", lines))
            if mark not in ("blank", "duplicate"):
                more = 5 * (mark == "truncated")
                if role:
                    step(after, out + role[0], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    step(after, out + new[0], (cost + 1 + more, audit + "R", (*lines, f"{new}:{text}")))
        best = after
    return min(v for out, v in best.items() if re.fullmatch("(s?(ua)+)?", out))


def step(best, out, value):
    """Outputs stand for others that the rest of the pattern can't tell from them."""
    if not re.fullmatch("s?(ua)*u?", out):
        return
    out = out if len(out) < 4 else out[:-2]
    if out not in best or value[:2] < best[out][:2]:
        best[out] = value


def brute(rows, harm=True):
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        own = sorted(damaged(own) if harm else own, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        marks, turns = faults(own), {r[1] for r in own} - {None}
        cost, audit, lines = search(own, marks)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(marks.count(m) for m in ("blank", "duplicate", "truncated")),
            sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own)),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def frame(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, 3, "x") for r in rows], ROWS).repartition(partitions)


def conversation(rng, conv, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "sage"]
    texts = ["Good.", "Cut off", "", " \t", "Why? ", "Yes!\n", "Same.", "Same.", None, "été 🙂"]
    return [(conv, rng.choice([i, i, i, 2 * i, None]), rng.choice(roles) if rng.random() < 0.5 else roles[i % 2], rng.choice(texts) if rng.random() < 0.4 else f"Text {i}.") for i in range(n)]


def test_reports_equal_a_search_over_all_edits(spark, monkeypatch):
    rng = random.Random(13)
    rows = [r for conv in range(150) for r in conversation(rng, conv, rng.randrange(1, 12))]
    rows += conversation(rng, None, 6) + [(900, 1, "user", "Twice."), (900, 1, "user", "Twice."), (901, None, None, None)]
    rows += [(910 + i, t, "user", "Cut off") for i in range(40) for t in (1, 1, 2)]
    rows += [(902, i, "user", f"Only users {i}.") for i in range(40)] + conversation(rng, 903, 60)
    got = {r[0]: tuple(r)[1:] for r in repair.repair(repair.damage(frame(spark, rows))).collect()}
    assert got == brute(rows)


def test_segments_do_not_change_a_report():
    rng = random.Random(5)
    for n in (1, 2, 3, 5, 8, 21, 40):
        for _ in range(25):
            rows = [(r, t, r[:1], m) for r, t, m in ((rng.choice(["user", "user", "assistant", "system", "x"]), str(i), rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for i in range(n))]
            reports = []
            for size in (1, 2, 3, 7, 1000):
                c = repair._Conversation(7)
                for k, row in enumerate(rows):
                    if k and k % size == 0:
                        c.advance()
                    c.add(k, *row)
                reports.append(c.report())
            assert all(r == reports[-1] for r in reports)
            cost, audit, _ = search([(7, k, *r[:2]) for k, r in enumerate(rows)], [r[3] for r in rows])
            assert (reports[0]["cost"], reports[0]["audit"]) == (cost, audit)


def test_long_conversation(spark):
    n = 20_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("Line "), F.col("id"), F.lit(".")).alias("text"))
    report = repair.repair(rows).first()
    assert report.audit == "KR" * (n // 2) and report.cost == n // 2 and report.illegal == n - 1


def test_repaired_turns_are_what_the_digest_is_of(spark):
    rng = random.Random(2)
    rows = [r for conv in range(30) for r in conversation(rng, conv, rng.randrange(1, 9))] + conversation(rng, None, 5)
    turns = repair.damage(frame(spark, rows))
    reports = repair.repair(turns)
    lines = {}
    for r in repair.repaired_turns(turns, reports).orderBy("conv_id", "position").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in reports.collect():
        assert hashlib.sha256("\n".join(lines.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


def test_dropped_and_missing_rows(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = repair.repair(repair.damage(frame(spark, [(dropped, 0, "user", "Hi.")]))).collect()
    assert [tuple(r) for r in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repair(repair.damage(frame(spark, []))).count() == 0


def test_query_on_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in queries.op13_conversation_repair(spark, sf).collect()}
    assert got == brute(rows) and any(v[5] for v in got.values())

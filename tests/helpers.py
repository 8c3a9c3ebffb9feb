"""Small log fixtures and brute-force answers."""

from __future__ import annotations

from collections import defaultdict


def line(day, clock, host, endpoint, code, size=1):
    """`day` is a day of July 1995."""
    return (
        f'{host} - - [{day:02d}/Jul/1995:{clock} -0400] "GET {endpoint} HTTP/1.0" {code} {size}'
    )


def mixed_lines(n=3000, days=4, hosts=40, endpoints=25):
    """Skewed traffic: one host sends a third of all lines, one day holds half of them."""
    out = []
    for i in range(n):
        day = 1 if i % 2 else 1 + (i // 2) % days
        host = "hot.example" if i % 3 == 0 else f"h{(i * 7) % hosts}.example"
        endpoint = "/hot" if i % 3 == 1 else f"/e{(i * 11) % endpoints}"
        code = [200, 200, 304, 404, 500, 302][(i * 5 + i // 7) % 6]
        out.append(
            line(day, f"{i % 24:02d}:{(i * 13) % 60:02d}:{i % 60:02d}", host, endpoint, code, i % 97)
        )
    return out


def text(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def brute_breakdown(logs, keys, last_by, min_code=None, min_count=None, k=20):
    """Rows as dicts -> {(date, *keys): (count, last_time, percentage)} per day, top k."""
    total, last, count = defaultdict(int), {}, defaultdict(int)
    for r in logs:
        total[r["date"]] += 1
        seen = (r["date"], *[r[x] for x in last_by])
        last[seen] = max(last.get(seen, ""), r["date_time"])
        if min_code is None or r["response_code"] >= min_code:
            count[(r["date"], *[r[x] for x in keys])] += 1
    days = defaultdict(list)
    for key, n in count.items():
        if min_count is None or n > min_count:
            days[key[0]].append((-n, key[1:]))
    out = {}
    for date, rows in days.items():
        for n, key in sorted(rows)[:k]:
            by = dict(zip(keys, key))
            out[(date, *key)] = (
                -n, last[(date, *[by[x] for x in last_by])], round(-n / total[date] * 100, 2),
            )
    return out

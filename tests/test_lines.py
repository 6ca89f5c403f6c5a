"""Loading lines against a plain parser."""

import random

from relweave.sources.lines import classify_lines, load_triples

KINDS = ["founder", "employer"]


def plain(line):
    """(reason, fields) by reading character by character."""
    if line is None or not line.strip() or line.startswith("#"):
        return None
    fields, i, n = [], 0, len(line)
    ok = True
    while True:
        j = i
        while j < n and line[j].isspace() and line[j] != "\t":
            j += 1
        if j < n and line[j] == '"':
            j += 1
            value = ""
            while True:
                if j >= n:
                    ok = False
                    break
                if line[j] == '"':
                    if j + 1 < n and line[j + 1] == '"':
                        value += '"'
                        j += 2
                        continue
                    j += 1
                    break
                value += line[j]
                j += 1
            while j < n and line[j] != "\t":
                if not line[j].isspace():
                    ok = False
                j += 1
        else:
            k = line.find("\t", i)
            k = n if k < 0 else k
            value = line[i:k]
            if '"' in value:
                ok = False
            j = k
        fields.append(value.strip())
        if not ok or j >= n:
            break
        i = j + 1
    if not ok:
        return "quoting", None
    if len(fields) != 3:
        return "column_count", None
    bad = lambda v: not any(c.isalpha() for c in v) or v.startswith(("/", "m/")) or any((ord(c) < 32 and c != "\t") or 127 <= ord(c) < 160 or c == "�" for c in v)
    if fields[1] not in KINDS or bad(fields[0]) or bad(fields[2]):
        return "invalid_value", None
    return "valid", fields


def lines():
    rng = random.Random(5)
    out = ['a\tfounder\tb', '"a ""x"" y"\tfounder\t" b\tc "', 'a"b\tfounder\tc', '"a"b\tfounder\tc', '""\tfounder\tb', '"a\tfounder\tb', 'a\tfounder', 'a\tfounder\tb\t', '  # x', '#c\tfounder\td',
           "", "   ", None, 'a\tfounder\tb\n', 'a\u0007\tfounder\tb', 'm/01\tfounder\tb', '/m/1\tfounder\tb', '12\tfounder\tb', 'a\tFounder\tb', 'a\t"founder"\tb ', 'a\tfounder\t� b', '\t\t', '""""\tfounder\ta',
           '"a"\t"founder"\t"b"', '\u0001ab\tfounder\tc', 'é\tfounder\tß', '"' * 2001 + "\tfounder\tb", "x" * 100_000 + "\tfounder\ty", "a\tfounder\tb\r", '"a" "b"\tfounder\tc']
    for _ in range(1500):
        out.append("".join(rng.choice(['a', 'b ', '"', '"', '\t', '\t', 'founder', '\tfounder\t', ' ', '""', '#', '\u0001', 'm/', ' ']) for _ in range(rng.randint(1, 9))))
    return out


def test_reasons_and_values(spark):
    data = lines()
    df = spark.createDataFrame([(i, x, "was") for i, x in enumerate(data)], "line_id bigint, line string, reason string")
    kinds = spark.createDataFrame([(k,) for k in [*KINDS, None, "founder"]], "r string")
    got = {r.line_id: r for r in classify_lines(df, "line", kinds).collect()}
    for i, x in enumerate(data):
        want = plain(x)
        if want is None:
            assert i not in got, x
        elif want[0] == "valid":
            assert got[i].reason is None and [got[i].e1, got[i].r, got[i].e2] == want[1], (x, got[i])
        else:
            assert (got[i].reason, got[i].raw, got[i].e1) == (want[0], x, None), x


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([], "line_id bigint, line string")
    kinds = spark.createDataFrame([("founder",)], "r string")
    valid, rejected = load_triples(df, "line", kinds)
    assert valid.count() == rejected.count() == 0
    df = spark.createDataFrame([(1, "a\tfounder\tb")] * 3 + [(2, "x")] * 2, "line_id bigint, line string")
    valid, rejected = load_triples(df, "line", kinds)
    assert valid.count() == 3 and rejected.count() == 2

"""The path language by plain Python over one message, to hold the engine against."""

import math
import re

SCAN_FAILED = object()


def lines_of(message):
    lines = re.split("\r\n|\r|\n", message)
    return lines[:-1] if len(lines) > 1 and lines[-1] == "" else lines


def scan_error(message):
    if not message.startswith("MSH"):
        return ("MissingMsh", 0, None)
    first = re.split("\r\n|\r|\n", message)[0]
    if len(first.encode()) < 8:
        return ("TruncatedMsh", len(first.encode()), None)
    at = 0
    for k, m in enumerate(re.finditer("([^\r\n]*)(\r\n|\r|\n|$)", message)):
        if k >= len(lines_of(message)):
            break
        if k and not re.match("[A-Z][A-Z0-9]{2}", m[1]):
            return ("UnrecognizedSegment", len(message[: m.start()].encode()), k)
        at = m.end()
    return None


def number(s):
    return float(s) if re.fullmatch(r"[+-]?(?i:inf|infinity|nan|(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)", s) else None


def evaluate(message, path):
    """The values, or ("error", operator), or SCAN_FAILED."""
    if scan_error(message):
        return SCAN_FAILED
    fs, cs, rs, _, ss = message[3:8]
    m = re.fullmatch(r"(?P<seg>\w{3})(?:\[(?P<idx>[^\]]*)\])?(?:-(?P<f>\d+)(?:\[(?P<rep>[^\]]*)\])?(?:\.(?P<c>\d+)(?:\.(?P<s>\d+))?)?)?", path)
    part = lambda parts, n: parts[n] if 0 <= n < len(parts) else ""

    def field(line, n):
        parts = line.split(fs)
        if m["seg"] == "MSH":
            return fs if n == 1 else part(parts, n - 1) if n else ""
        return part(parts, n)

    def sub(text, c, s):
        if c is None:
            return text
        text = part(text.split(cs), int(c) - 1)
        return text if s is None else part(text.split(ss), int(s) - 1)

    def pick(xs, i):
        if i in (None, "*"):
            return xs
        if i == "$LAST":
            return xs[-1:]
        return xs[int(i) - 1 : int(i)] if int(i) else []

    own = [x for x in lines_of(message) if x[:3] == m["seg"]]
    if m["idx"] and m["idx"].startswith("@"):
        g = re.fullmatch(r"@(\d+)(?:\.(\d+)(?:\.(\d+))?)?[ \t]*([!<>=]+)[ \t]*'([^']*)'", m["idx"])
        kept = []
        for line in own:
            target, values, op = sub(field(line, int(g[1])), g[2], g[3]), g[5].split("||"), g[4]
            if op in ("=", "!="):
                good = any((target == v) == (op == "=") for v in values)
            else:
                a, good = number(target), False
                if a is None:
                    return ("error", op)
                for v in values:
                    b = number(v)
                    if b is None:
                        return ("error", op)
                    if not (math.isnan(a) or math.isnan(b)) and {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]:
                        good = True
                        break
            if good:
                kept.append(line)
        own = kept
    else:
        own = pick(own, m["idx"])
    if m["f"] is None:
        return [[x] for x in own]
    found = [[sub(r, m["c"], m["s"]) for r in pick(field(x, int(m["f"])).split(rs), m["rep"])] for x in own]
    return [x for x in found if x]

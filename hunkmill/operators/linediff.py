"""Line differences of two versions of a file, in linear space, as unified diffs."""

from __future__ import annotations

import re

#: Lines of context around a change.
CONTEXT = 3
#: Steps after which the search for a middle takes the furthest point reached; the result stays a diff, if not the shortest.
MOST_STEPS = 256
#: Bytes looked at for a NUL, which marks a file as binary; and of a line shown after a hunk's header.
BINARY_BYTES, SHOWN = 8000, 80
_FUNCTION = re.compile(rb"[A-Za-z_$]")


def _middle(a: list, b: list, x0: int, x1: int, y0: int, y1: int) -> tuple[int, int]:
    """A point on a shortest way from (x0, y0) to (x1, y1), found from both ends at once."""
    low, high = x0 - y1, x1 - y0
    ahead, back = x0 - y0, x1 - y1
    odd = (ahead - back) & 1
    far, near = {ahead: x0}, {back: x1}
    f0 = f1 = ahead
    b0 = b1 = back
    for step in range(1, MOST_STEPS + 1):
        f0, f1 = (f0 - 1 if f0 > low else f0 + 1), (f1 + 1 if f1 < high else f1 - 1)
        for d in range(f1, f0 - 1, -2):
            left, right = far.get(d - 1, -1), far.get(d + 1, -1)
            x = left + 1 if left >= right else right
            while x < x1 and x - d < y1 and a[x] == b[x - d]:
                x += 1
            far[d] = x
            if odd and b0 <= d <= b1 and near.get(d, x1 + 1) <= x:
                return x, x - d
        b0, b1 = (b0 - 1 if b0 > low else b0 + 1), (b1 + 1 if b1 < high else b1 - 1)
        for d in range(b1, b0 - 1, -2):
            left, right = near.get(d - 1, x1 + 1), near.get(d + 1, x1 + 1)
            x = left if left < right else right - 1
            while x > x0 and x - d > y0 and a[x - 1] == b[x - d - 1]:
                x -= 1
            near[d] = x
            if not odd and f0 <= d <= f1 and far.get(d, -1) >= x:
                return x, x - d
        if step == MOST_STEPS:
            break
    return max(((min(x, x1), min(x, x1) - d) for d, x in far.items() if y0 <= min(x, x1) - d <= y1 and x >= x0), key=sum)


def _search(a: list, b: list, gone: bytearray, come: bytearray, at: list[int], bt: list[int]) -> None:
    """Marks lines (at, bt: their places in the files) that have no partner."""
    stack = [(0, len(a), 0, len(b))]
    while stack:
        x0, x1, y0, y1 = stack.pop()
        while x0 < x1 and y0 < y1 and a[x0] == b[y0]:
            x0, y0 = x0 + 1, y0 + 1
        while x0 < x1 and y0 < y1 and a[x1 - 1] == b[y1 - 1]:
            x1, y1 = x1 - 1, y1 - 1
        if x0 == x1 or y0 == y1:
            for x in range(x0, x1):
                gone[at[x]] = 1
            for y in range(y0, y1):
                come[bt[y]] = 1
            continue
        x, y = _middle(a, b, x0, x1, y0, y1)
        stack += [(x0, x, y0, y), (x, x1, y, y1)]


def _settle(flags: bytearray, lines: list, other: bytearray) -> None:
    """Moves each run of marked lines as far down as equal lines let it, or to the last place beside a run of the other file."""
    n = len(flags)
    kept = [-1, *[i for i, f in enumerate(other) if not f], len(other)]
    beside = lambda gap: kept[gap + 1] - kept[gap] > 1
    i = gap = 0
    while i < n:
        if not flags[i]:
            i, gap = i + 1, gap + 1
            continue
        s, e = i, i + 1
        while e < n and flags[e]:
            e += 1
        while True:
            size = e - s
            while s > 0 and lines[s - 1] == lines[e - 1]:
                flags[s - 1], flags[e - 1] = 1, 0
                s, e, gap = s - 1, e - 1, gap - 1
                while s > 0 and flags[s - 1]:
                    s -= 1
            last = e if beside(gap) else None
            while e < n and lines[s] == lines[e]:
                flags[s], flags[e] = 0, 1
                s, e, gap = s + 1, e + 1, gap + 1
                while e < n and flags[e]:
                    e += 1
                if beside(gap):
                    last = e
            if e - s == size:
                break
        while last is not None and e > last:
            flags[s - 1], flags[e - 1] = 1, 0
            s, e, gap = s - 1, e - 1, gap - 1
        i = e


def marks(old: list, new: list) -> tuple[bytearray, bytearray]:
    """Which lines of `old` are gone and which of `new` have come."""
    gone, come = bytearray(len(old)), bytearray(len(new))
    start, end = 0, 0
    while start < min(len(old), len(new)) and old[start] == new[start]:
        start += 1
    while end < min(len(old), len(new)) - start and old[-1 - end] == new[-1 - end]:
        end += 1
    here, there = set(old[start:len(old) - end]), set(new[start:len(new) - end])
    at = [i for i in range(start, len(old) - end) if old[i] in there]
    bt = [i for i in range(start, len(new) - end) if new[i] in here]
    for flags, lines, found, stop in ((gone, old, there, len(old) - end), (come, new, here, len(new) - end)):
        for i in range(start, stop):
            flags[i] = lines[i] not in found
    number = {line: i for i, line in enumerate(here & there)}
    _search([number[old[i]] for i in at], [number[new[i]] for i in bt], gone, come, at, bt)
    _settle(gone, old, come)
    _settle(come, new, gone)
    return gone, come


def _runs(gone: bytearray, come: bytearray):
    """(first old line, lines gone, first new line, lines come) of each change."""
    x = y = 0
    while x < len(gone) or y < len(come):
        x0, y0 = x, y
        while x < len(gone) and gone[x]:
            x += 1
        while y < len(come) and come[y]:
            y += 1
        if x > x0 or y > y0:
            yield x0, x - x0, y0, y - y0
        else:
            x, y = x + 1, y + 1


def hunks(old: bytes, new: bytes) -> bytes:
    """The hunks of a unified diff; empty for equal versions."""
    a, b = _lines(old), _lines(new)
    groups: list[list] = []
    for run in _runs(*marks(a, b)):
        if groups and run[0] - (groups[-1][-1][0] + groups[-1][-1][1]) <= 2 * CONTEXT:
            groups[-1].append(run)
        else:
            groups.append([run])
    out = []
    for group in groups:
        (x0, _, y0, _), (x, gone, y, come) = group[0], group[-1]
        before, after = min(CONTEXT, x0), min(CONTEXT, len(a) - x - gone)
        x0, y0, x1, y1 = x0 - before, y0 - before, x + gone + after, y + come + after
        shown = next((line for line in reversed(a[:x0]) if _FUNCTION.match(line)), b"").rstrip()[:SHOWN].rstrip()
        span = lambda at, end: b"%d" % (at + (end > at)) + (b"" if end - at == 1 else b",%d" % (end - at))
        out.append(b"@@ -%s +%s @@%s\n" % (span(x0, x1), span(y0, y1), b" " + shown if shown else b""))
        at = x0
        for x, gone, y, come in group:
            parts = [(b" ", a[at:x]), (b"-", a[x:x + gone]), (b"+", b[y:y + come])]
            out += [mark + line if line.endswith(b"\n") else mark + line + b"\n\\ No newline at end of file\n" for mark, lines in parts for line in lines]
            at = x + gone
        out += [b" " + line if line.endswith(b"\n") else b" " + line + b"\n\\ No newline at end of file\n" for line in a[at:x1]]
    return b"".join(out)


def _lines(text: bytes) -> list[bytes]:
    parts = text.split(b"\n")
    return [p + b"\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def quoted(name: bytes) -> bytes:
    """A path as a diff shows it: in quotes with escapes if it holds bytes that need them."""
    known = {7: b"\\a", 8: b"\\b", 9: b"\\t", 10: b"\\n", 11: b"\\v", 12: b"\\f", 13: b"\\r", 34: b'\\"', 92: b"\\\\"}
    shown = b"".join(known.get(c) or (bytes([c]) if 32 <= c < 127 else b"\\%03o" % c) for c in name)
    return b'"' + shown + b'"' if shown != name else name


def file_diff(path: bytes, old: tuple[str, str, bytes] | None, new: tuple[str, str, bytes] | None) -> bytes:
    """The diff of one file. old, new: (mode, object id, content), None where the file is missing."""
    a, b = quoted(b"a/" + path), quoted(b"b/" + path)
    head = b"diff --git %s %s\n" % (a, b)
    if old is None:
        head += b"new file mode %s\n" % new[0].encode()
    elif new is None:
        head += b"deleted file mode %s\n" % old[0].encode()
    elif old[0] != new[0]:
        head += b"old mode %s\nnew mode %s\n" % (old[0].encode(), new[0].encode())
    before, after = (old or ("", "0" * 40, b"")), (new or ("", "0" * 40, b""))
    if before[1] == after[1]:
        return head
    same = b" " + old[0].encode() if old and new and old[0] == new[0] else b""
    head += b"index %s..%s%s\n" % (before[1].encode(), after[1].encode(), same)
    left, right = b"/dev/null" if old is None else a, b"/dev/null" if new is None else b
    if b"\0" in before[2][:BINARY_BYTES] or b"\0" in after[2][:BINARY_BYTES]:
        return head + b"Binary files %s and %s differ\n" % (left, right)
    body = hunks(before[2], after[2])
    tab = b"\t" if b" " in path else b""
    return head + (b"--- %s%s\n+++ %s%s\n" % (left, tab if old else b"", right, tab if new else b"") + body if body else b"")

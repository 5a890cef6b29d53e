"""Differences of two word sequences by longest common runs.

The longest run of words that both sides share is kept (the earliest in the first
text, then the earliest in the second), and the parts before and after it are compared in
the same way. The length of the longest run comes from one walk of the first text over a
suffix automaton of the second, in time linear in both, however often words repeat. All runs of
that length are then taken from left to right, as comparing what follows each of them
anew would take them; what is left between them has shorter runs only.
"""

from __future__ import annotations

from bisect import bisect_left


def longest_run(a: list[int], b: list[int]) -> int:
    """Length of the longest common run."""
    step: list[dict[int, int]] = [{}]
    link, size = [-1], [0]  # suffix links and longest strings
    last = 0
    for word in b:
        new = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and word not in step[p]:
            step[p][word] = new
            p = link[p]
        if p >= 0:
            q = step[p][word]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(step[q].copy())
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and step[p].get(word) == q:
                    step[p][word] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    best = at = length = 0
    for word in a:
        while at and word not in step[at]:
            at = link[at]
            length = size[at]
        if word in step[at]:
            at = step[at][word]
            length += 1
            best = max(best, length)
    return best


def run_numbers(both: list[list[int]], n: int) -> list[list[int]]:
    """For each sequence the numbers of its runs of ``n`` words by place; equal runs have equal numbers."""
    width = 1
    while width < n:
        shift = min(width, n - width)
        numbers: dict[tuple[int, int], int] = {}
        both = [[numbers.setdefault(x, len(numbers)) for x in zip(ids, ids[shift:])] for ids in both]
        width += shift
    return both


def common_runs(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """All runs that both sides keep, in order; runs that touch on both sides are one."""
    numbers: dict[str, int] = {}
    left, right = ([numbers.setdefault(w, len(numbers)) for w in words] for words in (a, b))
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a_from, a_to, b_from, b_to = todo.pop()
        if a_from == a_to or b_from == b_to:
            continue
        base, mine, other = a_from, left[a_from:a_to], right[b_from:b_to]
        n = longest_run(mine, other)
        if not n:
            continue
        mine, other = run_numbers([mine, other], n)
        places: dict[int, list[int]] = {}
        for j, number in enumerate(other):
            places.setdefault(number, []).append(b_from + j)
        i = a_from
        while i <= a_to - n:
            at = places.get(mine[i - base], ())
            k = bisect_left(at, b_from)
            if k == len(at):
                i += 1
                continue
            found.append((i, at[k], n))
            todo.append((a_from, i, b_from, at[k]))
            a_from, b_from = i + n, at[k] + n
            i = a_from
        todo.append((a_from, a_to, b_from, b_to))
    out: list[tuple[int, int, int]] = []
    for i, j, n in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


def segments(before: str | None, after: str | None) -> list[tuple[str, str]]:
    """(text, change_type) of the word runs that stay, go and come, in order."""
    left, right = (before or "").split(), (after or "").split()
    out, i, j = [], 0, 0
    for at, to, n in [*common_runs(left, right), (len(left), len(right), 0)]:
        out += [(left[i:at], "REMOVED"), (right[j:to], "ADDED"), (left[at : at + n], "UNCHANGED")]
        i, j = at + n, to + n
    return [(" ".join(words), kind) for words, kind in out if words]

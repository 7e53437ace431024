"""Linear suffix sorting by grouping (no recursion, no renaming)."""

from __future__ import annotations

from array import array


def suffix_array(text: bytes) -> array:
    """The starts of the suffixes of ``text`` in lexicographic order; a suffix that is
    a prefix of another comes first.

    Suffixes are grouped by their longest Lyndon prefix. Groups start as the
    suffixes of one first byte and are processed from the greatest down: each member
    ``s`` of the current group points to ``p``, the nearest suffix before it in a
    smaller group (the previous smaller one). The text at ``p`` then goes on with the group's
    word, as often as members point to ``p``; these ``p`` leave their group for new
    ones just above it, the more repeats the higher. When all groups are done, each
    suffix's word ends where its next smaller suffix starts, so walking the order from the
    least suffix and handing out places to those whose word ends there
    emits every group's own order."""
    n = len(text)
    members: list[list[int]] = [[] for _ in range(256)]
    for i, c in enumerate(text):
        members[c].append(i)
    group, word = array("i", list(text)), array("i", [1]) * n
    # groups in ascending order as a linked list
    used = [c for c in range(256) if members[c]]
    below, above = {}, {}
    for a, b in zip(used, used[1:]):
        above[a], below[b] = b, a
    smaller = array("i", [-1]) * n  # previous smaller suffix; set when the suffix's group is processed
    done = bytearray(n)
    current = used[-1] if used else None
    size = len(members)
    order: list[tuple[int, int]] = []  # processed groups with their sizes
    while current is not None:
        own = [s for s in members[current] if group[s] == current]
        members[current] = ()
        if own:
            order.append((current, len(own)))
            for s in own:
                done[s] = 1
            repeats: dict[int, int] = {}
            for s in own:
                p = s - 1
                while p >= 0 and done[p]:
                    p = smaller[p]
                smaller[s] = p
                if p >= 0:
                    repeats[p] = repeats.get(p, 0) + 1
            length = word[own[0]]
            if len(repeats) == 1:
                (p, c), = repeats.items()
                moved = [((group[p], c), [p])]
            else:
                sets: dict[tuple[int, int], list[int]] = {}
                for p, c in repeats.items():
                    sets.setdefault((group[p], c), []).append(p)
                moved = sorted(sets.items(), key=lambda x: -x[0][1]) if len(sets) > 1 else sets.items()
            for (g, c), ps in moved:  # more repeats first: later ones go in below them
                new, size = size, size + 1
                members.append(ps)
                for p in ps:
                    group[p] = new
                    word[p] += c * length
                up = above.get(g)
                above[g], below[new] = new, g
                if up is not None:
                    above[new], below[up] = up, new
        current = below.get(current)
    # places: groups ascending
    place, at = [0] * size, 0
    for g, count in reversed(order):
        place[g] = at
        at += count
    result = array("i", [0]) * n
    k = -1
    i = n  # the empty suffix, less than all
    while True:
        j = i - 1
        while j >= 0 and j + word[j] == i:
            g = group[j]
            result[place[g]] = j
            place[g] += 1
            j = smaller[j]
        k += 1
        if k == n:
            return result
        i = result[k]

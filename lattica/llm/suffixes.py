"""Suffix sorting by the deep-shallow method, on a set of strings.

Multikey quicksort orders the strings to a shallow depth; groups that still agree there have long common
prefixes and go to a blind trie, which looks at branching bytes only and compares each string in full once.
"""

from __future__ import annotations

#: Bytes that multikey quicksort looks at before a group goes to the blind trie.
SHALLOW = 24


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, known to be at least `at`."""
    most = min(len(a), len(b))
    if a[at:most] == b[at:most]:
        return most
    low, high = at, most  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def deep_shallow_sort(strings: list[bytes], start: int = 0) -> list[int]:
    """Places of strings in ascending order; all share their first `start` bytes. Equal strings keep their order."""
    out: list[int] = []
    todo = [(list(range(len(strings))), start)]
    while todo:
        group, depth = todo.pop()
        if len(group) < 2:
            out += group
        elif depth - start >= SHALLOW:
            out += blind_trie_sort(strings, group, depth)
        else:  # three ways by the byte at depth; ended strings come first
            keys = [strings[i][depth] if len(strings[i]) > depth else -1 for i in group]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            less = [i for i, k in zip(group, keys, strict=True) if k < pivot]
            same = [i for i, k in zip(group, keys, strict=True) if k == pivot]
            more = [i for i, k in zip(group, keys, strict=True) if k > pivot]
            todo.append((more, depth))
            if pivot < 0:
                out += same  # nothing sorts below ended strings
            else:
                todo += [(same, depth + 1), (less, depth)]
    return out


class _Node:
    """Strings below agree on `skip` bytes; children by the next byte (-1: the string ends)."""

    __slots__ = ("children", "items", "skip")

    def __init__(self, skip: int, items: list[int] | None):
        self.skip, self.items, self.children = skip, items, {}


def blind_trie_sort(strings: list[bytes], group: list[int], depth: int) -> list[int]:
    """group in ascending order of its strings, which share their first `depth` bytes."""
    root = _Node(len(strings[group[0]]), [group[0]])
    for i in group[1:]:
        s = strings[i]
        # blindly down to some leaf: only branching bytes are looked at
        node = root
        while node.items is None:
            key = s[node.skip] if len(s) > node.skip else -1
            node = node.children.get(key) or next(iter(node.children.values()))
        t = strings[node.items[0]]
        same = common(s, t, depth)
        if same == len(s) == len(t):
            node.items.append(i)
            continue
        # down again to where the string leaves the trie
        parent, key, node = None, None, root
        while node.items is None and node.skip < same:
            parent, key = node, s[node.skip] if len(s) > node.skip else -1
            node = node.children[key]
        mine = _Node(len(s), [i])
        own = s[same] if len(s) > same else -1
        if node.items is None and node.skip == same:
            node.children[own] = mine
            continue
        fork = _Node(same, None)
        fork.children = {t[same] if len(t) > same else -1: node, own: mine}
        if parent is None:
            root = fork
        else:
            parent.children[key] = fork
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.items is not None:
            out += node.items
        else:
            todo += [node.children[k] for k in sorted(node.children, reverse=True)]
    return out

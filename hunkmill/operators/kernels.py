"""Order-dependent steps on one change set, in plain Python; they run inside grouped tasks and on small inputs."""

from __future__ import annotations

import functools
from collections import defaultdict

import numpy as np
import pyarrow as pa

from ..functions import fixed


def plain(values: pa.Array) -> list:
    """values.to_pylist() for nested columns of many small rows: leaves are turned column by column, not one by one."""
    if pa.types.is_struct(values.type):
        names = [values.type.field(i).name for i in range(values.type.num_fields)]
        if not names:
            return values.to_pylist()
        out = [dict(zip(names, x, strict=True)) for x in zip(*map(plain, values.flatten()), strict=True)]
    elif pa.types.is_list(values.type):
        flat, sizes = plain(values.flatten()), values.value_lengths().fill_null(0).to_numpy()
        ends = np.cumsum(sizes).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    elif pa.types.is_string(values.type) or values.null_count == 0 and (pa.types.is_integer(values.type) or pa.types.is_floating(values.type)):
        return values.to_numpy(zero_copy_only=False).tolist()
    else:
        return values.to_pylist()
    return [x if there else None for x, there in zip(out, values.is_valid().to_numpy(zero_copy_only=False).tolist(), strict=True)] if values.null_count else out


@functools.lru_cache(1 << 16)
def facts_of(file: str) -> dict:
    """What the kernels ask of a path: dir, parent (null at the root), stem, group_layer and pack_layer, by the rules of
    functions.scalars."""
    path, low = file.replace("\\", "/"), file.lower()
    parent = path.rpartition("/")[0] if "/" in path else None
    has = lambda parts: any(p in low for p in parts)
    other = "util" if has(fixed.UTILITIES) else "controller" if has(fixed.CONTROLLERS) else "impl"
    layer = lambda interfaces: "interface" if has(interfaces) else other
    return {
        "dir": "root" if parent is None else parent, "parent": parent, "stem": file.rpartition("/")[2].split(".")[0],
        "group_layer": layer(fixed.GROUP_INTERFACES), "pack_layer": layer(fixed.PACK_INTERFACES),
    }


#: Arrow's types for the names of simple columns.
ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def batch_of(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    """rows as a batch with these columns."""
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def rows_of(batch: pa.RecordBatch) -> list[dict]:
    """batch.to_pylist(), by plain()."""
    return [dict(zip(batch.schema.names, x, strict=True)) for x in zip(*map(plain, batch.columns), strict=True)]


def components(nodes: list[str], edges: list[tuple[str, str]]) -> list[list[str]]:
    """Strongly connected components with two nodes or more, members and components in the order of nodes."""
    if not edges:
        return []
    after: dict[str, list[str]] = defaultdict(list)
    for a, b in edges:
        after[a].append(b)
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    on, stack, found = set(), [], []
    for root in nodes:
        if root in index:
            continue
        work = [(root, iter(after[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(after[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    own = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        own.append(w)
                        if w == v:
                            break
                    if len(own) > 1:
                        found.append(own)
    place = {n: i for i, n in enumerate(nodes)}
    found = [sorted(c, key=lambda n: place.get(n, len(place))) for c in found]
    return sorted(found, key=lambda c: place.get(c[0], len(place)))


def levels_of(nodes: list, edges: list[tuple]) -> dict:
    """Level of each node, prerequisites at lower ones, for edges (dependent, prerequisite); nodes behind a cycle have none."""
    waiting = dict.fromkeys(nodes, 0)
    users = defaultdict(list)
    for a, b in edges:
        waiting[a] += 1
        users[b].append(a)
    level, depth = {}, 0
    ready = [n for n, k in waiting.items() if not k]
    while ready:
        after = []
        for n in ready:
            level[n] = depth
            for a in users[n]:
                waiting[a] -= 1
                if not waiting[a]:
                    after.append(a)
        ready, depth = after, depth + 1
    return level


def prerequisite_order(nodes: list, edges: list[tuple]) -> tuple[list, list[tuple]]:
    """Nodes by (level, place), prerequisites first, for edges (dependent, prerequisite); and the edges that were cut.

    While a cycle stands, the last of its edges in sorted order is cut.
    """
    if not edges:
        return list(nodes), []
    place = {n: i for i, n in enumerate(nodes)}
    live = sorted({e for e in edges if e[0] in place and e[1] in place and e[0] != e[1]}, key=lambda e: (place[e[0]], place[e[1]]))
    cut = []
    while True:
        level = levels_of(nodes, live)
        if len(level) == len(nodes):
            return sorted(nodes, key=lambda n: (level[n], place[n])), cut
        inner = components([n for n in nodes if n not in level], [e for e in live if e[0] not in level and e[1] not in level])
        for ring in inner:
            own = set(ring)
            back = max((e for e in live if e[0] in own and e[1] in own), key=lambda e: (place[e[0]], place[e[1]]))
            live.remove(back)
            cut.append(back)


def simple_cycles(nodes: list, edges: list[tuple]):
    """Every cycle that meets no node twice, one at a time: each from its first node in the order of nodes, cycles in the
    order of their nodes. A node from which the start was not reached stays closed until one after it is freed."""
    place = {n: i for i, n in enumerate(nodes)}
    after = defaultdict(list)
    for a, b in sorted({e for e in edges if e[0] in place and e[1] in place}, key=lambda e: (place[e[0]], place[e[1]])):
        after[a].append(b)
    for start in nodes:
        if start in after[start]:
            yield [start]
        later = [n for n in nodes if place[n] >= place[start]]
        rings = components(later, [(a, b) for a in later for b in after[a] if place[b] >= place[start]])
        own = next((set(r) for r in rings if start in r), None)
        if own is None:
            continue
        step = {v: [w for w in after[v] if w in own and w != v] for v in own}
        closed, waits, reached = {start}, defaultdict(set), set()
        path, stack = [start], [iter(step[start])]
        while stack:
            v = path[-1]
            for w in stack[-1]:
                if w == start:
                    reached.update(path)
                    yield list(path)
                elif w not in closed:
                    path.append(w)
                    stack.append(iter(step[w]))
                    closed.add(w)
                    reached.discard(w)
                    break
            else:
                if v in reached:
                    free = [v]
                    while free:
                        n = free.pop()
                        if n in closed:
                            closed.discard(n)
                            free.extend(waits.pop(n, ()))
                else:
                    for w in step[v]:
                        waits[w].add(v)
                stack.pop()
                path.pop()


def order_without_cycles(nodes: list, edges: list[tuple]) -> tuple[list, list[tuple], bool]:
    """Nodes with prerequisites first, for edges (dependent, prerequisite), the edges cut, and whether it failed.

    Of every simple cycle the edge from its last node to its first is cut. Where an edge would be cut twice, the order is
    that of nodes: so no more cycles are looked at than there are edges.
    """
    cut: dict[tuple, None] = {}
    for ring in simple_cycles(nodes, [e for e in edges if e[0] != e[1]]):
        if (ring[-1], ring[0]) in cut:
            return list(nodes), list(cut), True
        cut[ring[-1], ring[0]] = None
    return prerequisite_order(nodes, [e for e in edges if e not in cut])[0], list(cut), False


def longest_chain(depends_on: dict[int, list[int]]) -> int:
    """Nodes on the longest chain of dependencies; 0 for none. An edge that would close a cycle is not followed."""
    best: dict[int, int] = {}
    for start in depends_on:
        work, path = [(start, 0)], {start}
        while work:
            v, i = work[-1]
            nexts = [d for d in depends_on.get(v, []) if d in depends_on]
            if i < len(nexts):
                work[-1] = (v, i + 1)
                if nexts[i] not in best and nexts[i] not in path:
                    path.add(nexts[i])
                    work.append((nexts[i], 0))
            else:
                best[v] = 1 + max((best.get(d, 0) for d in nexts), default=0)
                path.discard(v)
                work.pop()
    return max(best.values(), default=0)


def critical_paths(nodes: list[str], edges: list[tuple[str, str]]):
    """Every simple path of three nodes or more from nodes nothing leads to, to nodes that lead nowhere, one at a time:
    their number may be exponential."""
    after, before = defaultdict(list), defaultdict(list)
    for a, b in dict.fromkeys(edges):
        after[a].append(b)
        before[b].append(a)
    stack = [[n] for n in reversed(nodes) if not before[n] and after[n]]
    while stack:
        path = stack.pop()
        if not after[path[-1]]:
            if len(path) > 2:
                yield path
            continue
        stack.extend([*path, n] for n in reversed(after[path[-1]]) if n not in path)


def keep_uncovered(groups: list[tuple[str, float, list[str]]]) -> list[int]:
    """Places of the groups (id, score, members) kept by descending score: those with under half of their members
    covered already."""
    covered: set[str] = set()
    kept = []
    for i in sorted(range(len(groups)), key=lambda i: -groups[i][1]):
        own = set(groups[i][2])
        if own and len(own & covered) / len(own) < 0.5:
            kept.append(i)
            covered |= own
    return kept


def symbol_clusters(names: dict[str, set[str]]) -> list[list[str]]:
    """Greedy clusters: each seed in order takes in all later unplaced changes with a Jaccard over 0.3 to the seed."""
    holders = defaultdict(list)
    for c, own in names.items():
        for s in own:
            holders[s].append(c)
    place = {c: i for i, c in enumerate(names)}
    done: set[str] = set()
    out = []
    for seed, own in names.items():
        if seed in done:
            continue
        done.add(seed)
        cluster = [seed]
        # Only changes that share a name can be similar.
        for other in sorted({c for s in own for c in holders[s]} - done, key=place.get):
            if len(own & names[other]) / len(own | names[other]) > 0.3:
                cluster.append(other)
                done.add(other)
        if len(cluster) > 1:
            out.append(cluster)
    return out


def pack_layers(ids: list[str], files: dict[str, str], sizes: dict[str, int], layers: dict[str, str], target: int) -> list[list[str]]:
    """Candidates in the order in which layers build on each other: all interfaces, all utilities, the implementation by
    directory (one of half a target alone, others together up to 1.5 targets), all controllers."""
    of = lambda layer: [i for i in ids if layers[i] == layer]
    by_dir = defaultdict(list)
    for i in of("impl"):
        by_dir[files[i].rpartition("/")[0] or "root"].append(i)
    packed: list[list[str]] = []
    held, size = [], 0
    for name in sorted(by_dir):
        own = by_dir[name]
        n = sum(sizes[i] for i in own)
        if n >= 0.5 * target or size + n > 1.5 * target:
            if held:
                packed.append(held)
            held, size = [], 0
        if n >= 0.5 * target:
            packed.append(own)
        else:
            held, size = held + own, size + n
    if held:
        packed.append(held)
    return [x for x in (of("interface"), of("util"), *packed, of("controller")) if x]


def merge_candidates(candidates: list[list[str]], sizes: dict[str, int], ring: dict[str, int], strong: set[tuple[str, str]], groups: dict[str, set[str]], target: int) -> list[list[str]]:
    """One pass over the candidates in order, each growing as it takes in later ones.

    Two merge when a change of one cannot be parted from one of the other (the same cycle, or a strong edge), whatever
    their size; else when both fit in 1.5 targets and over half of their groups are common.
    """
    place = {x: i for i, x in enumerate(sizes)}
    if len(candidates) == 1:
        return [sorted(set(candidates[0]), key=place.get)]
    linked = defaultdict(set)
    for a, b in strong:
        linked[a].add(b)
        linked[b].add(a)
    none: set = set()
    # Of each candidate its members, lines, groups, cycles and the changes it cannot be parted from.
    facts = [[set(own), sum(sizes[x] for x in own), none.union(*(groups.get(x, none) for x in own)), {ring[x] for x in own if x in ring}, none.union(*(linked.get(x, none) for x in own))] for own in candidates]
    used, out = set(), []
    for i, own in enumerate(facts):
        if i in used:
            continue
        for j in range(i + 1, len(facts)):
            if j in used:
                continue
            other = facts[j]
            join = not own[3].isdisjoint(other[3]) or not own[4].isdisjoint(other[0])
            if not join and own[1] + other[1] <= 1.5 * target and own[2] and other[2]:
                both = len(own[2] & other[2])
                join = both / (len(own[2]) + len(other[2]) - both) > 0.5
            if join:
                own = [own[0] | other[0], own[1] + other[1], own[2] | other[2], own[3] | other[3], own[4] | other[4]]
                used.add(j)
        out.append(sorted(own[0], key=place.get))
    return out


def parts_of(name: str) -> set[str]:
    """All parts of a name, the empty one too."""
    return {name[i:j] for i in range(len(name) + 1) for j in range(i, len(name) + 1)}


def families(changes: list[dict], symbols: list[dict]) -> list[tuple[str, float, list[str]]]:
    """(id, score, change ids) of all groups of one change set, in their fixed order. changes: ordered, with change_id,
    change_ord, file, type, line_start, line_end, dir, parent (null at the root), stem, group_layer; symbols: ordered, with
    change_id, name, type."""
    order = {c["change_id"]: c["change_ord"] for c in changes}
    in_order = lambda ids: sorted(ids, key=order.get)
    files, dirs, layers = {}, {}, {}
    for c in changes:
        own = c["change_id"]
        files.setdefault(c["file"], []).append(c)
        dirs.setdefault(c["dir"], []).append(own)
        layers.setdefault(c["group_layer"], []).append(own)
    out = []
    for i, rows in enumerate(files.values()):
        if len(rows) > 1:
            lines = sorted(rows, key=lambda c: (c["line_start"], c["change_ord"]))
            gaps = [max(0, b["line_start"] - a["line_end"]) for a, b in zip(lines, lines[1:], strict=False)]
            out.append((f"file_{i}", max(0.5, 1 - sum(gaps) / len(gaps) / 100), [c["change_id"] for c in rows]))
    out += [(f"subpkg_{i}", 0.85 if len(rows) > 1 else 0.7, rows) for i, rows in enumerate(dirs.values())]
    out += [(f"filetype_{layer}", fixed.LAYERS[layer], rows) for layer, rows in layers.items()]
    # Of each name its changes and how often it occurs; of each change the types and names of its symbols.
    held, times, kinds, names = {}, {}, {}, {}
    for x in symbols:
        name, own = x["name"], x["change_id"]
        if name in held:
            held[name][own] = None
            times[name] += 1
        else:
            held[name], times[name] = {own: None}, 1
        if own in names:
            kinds[own].add(x["type"])
            names[own][name] = None
        else:
            kinds[own], names[own] = {x["type"]}, {name: None}
    first = lambda name: (min(order.get(c, 0) for c in held[name]), name)
    out += [(f"rename_{i}", 0.95, in_order(held[name])) for i, name in enumerate(sorted((n for n, k in times.items() if k >= 3), key=first))]
    gone = [c for c in changes if c["type"] == "delete"]
    made = [c for c in changes if c["type"] == "add" and not {"function", "class"}.isdisjoint(kinds.get(c["change_id"], ()))] if gone else []
    # Deletions by directory, by name, and by each part of their name that is an addition's name.
    stems = {c["stem"] for c in made}
    in_dir, named, around = defaultdict(list), defaultdict(list), defaultdict(list)
    for i, d in enumerate(gone):
        in_dir[d["parent"]].append(i)
        named[d["stem"]].append(i)
        for part in parts_of(d["stem"]) & stems if made else ():
            around[part].append(i)
    found = []
    for c in made:
        own = {*in_dir.get(c["parent"], ()), *around.get(c["stem"], ())}
        if named:
            own.update(*(named[part] for part in parts_of(c["stem"]) if part in named))
        if own:
            found.append([c["change_id"], *(gone[i]["change_id"] for i in sorted(own))])
    out += [(f"extract_{i}", 0.9, own) for i, own in enumerate(found)]
    found = []
    for c in changes:
        if c["type"] == "modify" and not {"function", "method"}.isdisjoint(kinds.get(c["change_id"], ())):
            users = {u for name in names[c["change_id"]] for u in held[name]} - {c["change_id"]}
            if users:
                found.append([c["change_id"], *in_order(users)])
    out += [(f"api_{i}", 0.9, own) for i, own in enumerate(found)]
    common = {n for n, own in held.items() if len(own) > 1}
    if not common:
        return out
    shared = {c: common.intersection(names[c]) for c in in_order(names)}
    clusters = symbol_clusters({c: own for c, own in shared.items() if own})
    return out + [(f"symbol_{i}", 0.8, own) for i, own in enumerate(clusters)]

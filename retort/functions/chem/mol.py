"""Molecule graphs from SMILES, in plain Python.

The grammar is OpenSMILES.  Of stereochemistry tetrahedral centres and double bonds
outside rings are kept; a mark that says nothing (two like neighbours), or one of
another class, is dropped.  Explicit hydrogen atoms stay atoms and an upper-case ring stays
Kekulé until :func:`perceive` is asked for aromaticity, so both states survive
as text.  Canonical ranks follow CANGEN (Weininger et al. 1989).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

SYMBOLS = (
    "* H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn"
).split()
NUMBER = {s: k for k, s in enumerate(SYMBOLS)}
ORGANIC = {"B": (3,), "C": (4,), "N": (3, 5), "O": (2,), "P": (3, 5), "S": (2, 4, 6), "F": (1,), "Cl": (1,), "Br": (1,), "I": (1,)}
AROMATIC = {"b": "B", "c": "C", "n": "N", "o": "O", "p": "P", "s": "S", "se": "Se", "as": "As", "te": "Te"}
BONDS = {"-": 1.0, "=": 2.0, "#": 3.0, "$": 4.0, ":": 1.5, "/": 1.0, "\\": 1.0}
#: Valences allowed by charge, for the sanity check.
MAX_VALENCE = {"H": 1, "B": 3, "C": 4, "N": 3, "O": 2, "F": 1, "Si": 4, "P": 5, "S": 6, "Cl": 1, "Br": 1, "I": 5, "Se": 6}


class ChemError(ValueError):
    """A structure that can't be read or is impossible."""


@dataclass(frozen=True)
class Atom:
    symbol: str
    aromatic: bool = False
    charge: int = 0
    isotope: int = 0
    h: int = 0
    bracket: bool = False
    number: int = 0  # atom map

    @property
    def z(self) -> int:
        return NUMBER[self.symbol]


class Mol:
    """Atoms, bonds and stereochemistry.

    ``centres``: atom -> (1 for @ or -1 for @@, its neighbours in the order in which
    the mark was read, -1 for an implicit hydrogen).  ``sides``: double bond (i, j)
    -> (neighbour of i, neighbour of j, 1 if on one side or -1).
    """

    def __init__(self, atoms: list[Atom], bonds: dict[tuple[int, int], float], centres: dict[int, tuple[int, tuple[int, ...]]] | None = None, sides: dict[tuple[int, int], tuple[int, int, int]] | None = None):
        self.atoms, self.bonds = atoms, bonds
        self.centres, self.sides = centres or {}, sides or {}
        self.near: list[dict[int, float]] = [{} for _ in atoms]
        for (i, j), o in bonds.items():
            self.near[i][j] = o
            self.near[j][i] = o
        self._rings: list[tuple[int, ...]] | None = None
        self._text: str | None = None  # canonical, once it has been asked for

    def __len__(self) -> int:
        return len(self.atoms)

    def hydrogens(self, i: int) -> int:
        """Implicit and explicit hydrogens of an atom."""
        return self.atoms[i].h + sum(self.atoms[j].symbol == "H" for j in self.near[i])

    def degree(self, i: int) -> int:
        """Neighbours other than hydrogen."""
        return sum(self.atoms[j].symbol != "H" for j in self.near[i])

    def valence(self, i: int) -> int:
        a = self.atoms[i]
        total = sum(self.near[i].values())
        if any(o == 1.5 for o in self.near[i].values()):
            k = sum(o == 1.5 for o in self.near[i].values())
            total = total - 1.5 * k + k + (1 if a.symbol in ("C", "N", "P", "B") and not self._lone_pair(i) else 0)
        return int(total) + a.h

    def _lone_pair(self, i: int) -> bool:
        """Whether an aromatic atom gives two electrons (pyrrole N, furan O)."""
        a = self.atoms[i]
        if a.symbol in ("O", "S", "Se", "Te"):
            return True
        if a.symbol in ("N", "P", "As"):
            return a.charge <= 0 and (a.h > 0 or len(self.near[i]) == 3 or a.charge < 0)
        return a.symbol == "C" and a.charge < 0

    def components(self) -> list[list[int]]:
        seen, out = set(), []
        for s in range(len(self)):
            if s not in seen:
                part, todo = [], [s]
                seen.add(s)
                while todo:
                    i = todo.pop()
                    part.append(i)
                    for j in self.near[i]:
                        if j not in seen:
                            seen.add(j)
                            todo.append(j)
                out.append(sorted(part))
        return out

    def part(self, keep: list[int]) -> Mol:
        at = {i: k for k, i in enumerate(keep)}
        bonds = {(min(at[i], at[j]), max(at[i], at[j])): o for (i, j), o in self.bonds.items() if i in at and j in at}
        centres, sides = {}, {}
        for i, (sign, near) in self.centres.items():
            if i in at and sum(j not in at for j in near) <= 1:  # a hydrogen that becomes a count
                centres[at[i]] = (sign, tuple(at.get(j, -1) for j in near))
        for (i, j), (a, b, same) in self.sides.items():
            if i not in at or j not in at:
                continue
            if a not in at:
                a, same = next((x for x in self.near[i] if x in at and x != j), None), -same
            if b not in at:
                b, same = next((x for x in self.near[j] if x in at and x != i), None), -same
            if a is not None and b is not None:
                x, y = at[i], at[j]
                sides[min(x, y), max(x, y)] = (at[a], at[b], same) if x < y else (at[b], at[a], same)
        return Mol([self.atoms[i] for i in keep], bonds, centres, sides)

    def rings(self) -> list[tuple[int, ...]]:
        """A smallest set of smallest rings, from the shortest cycle through each bond."""
        if self._rings is None:
            want = len(self.bonds) - len(self) + len(self.components())
            found: set[tuple[int, ...]] = set()
            for i, j in self.bonds if want else ():
                back = {i: -1}
                todo = [i]
                while todo and j not in back:
                    later = []
                    for a in todo:
                        for b in self.near[a]:
                            if b not in back and (a, b) != (i, j):
                                back[b] = a
                                later.append(b)
                    todo = later
                if j in back:
                    path, a = [], j
                    while a != -1:
                        path.append(a)
                        a = back[a]
                    k = path.index(min(path))
                    path = path[k:] + path[:k]
                    found.add(tuple(path if path[1] < path[-1] else [path[0], *path[:0:-1]]))
            basis: list[int] = []
            out = []
            index = {frozenset(b): k for k, b in enumerate(self.bonds)}
            for ring in sorted(found, key=lambda r: (len(r), r)):
                bits = 0
                for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
                    bits ^= 1 << index[frozenset((a, b))]
                for b in basis:
                    bits = min(bits, bits ^ b)
                if bits:
                    basis.append(bits)
                    out.append(ring)
                if len(out) == want:
                    break
            self._rings = out
        return self._rings

    def ring_bonds(self) -> set[frozenset[int]]:
        return {frozenset(p) for r in self.rings() for p in zip(r, r[1:] + r[:1], strict=True)}


def _bracket(text: str) -> Atom:
    m = re.fullmatch(r"(\d+)?(\*|[A-Z][a-z]?|se|as|te|[bcnops])(@{0,2}(?:TH[12]|AL[12]|SP[123]|TB\d+|OH\d+)?)(H\d*)?(\+\+|--|[+-]\d*)?(?::(\d+))?", text)
    if not m:
        raise ChemError(f"can't read the atom [{text}]")
    iso, sym, _, h, charge, number = m.groups()
    aromatic = sym in AROMATIC
    symbol = AROMATIC.get(sym, sym)
    if symbol not in NUMBER:
        raise ChemError(f"unknown element {symbol}")
    q = 0 if not charge else {"++": 2, "--": -2}.get(charge) or int(charge[0] + (charge[1:] or "1"))
    return Atom(symbol, aromatic, q, int(iso or 0), 0 if not h else int(h[1:] or 1), True, int(number or 0))


def parse(smiles: str) -> Mol:
    """The graph of a SMILES; hydrogen counts of unbracketed atoms are filled in."""
    text = smiles.strip()
    atoms: list[Atom] = []
    bonds: dict[tuple[int, int], float] = {}
    stack: list[int] = []
    last, order, k = -1, None, 0
    open_: dict[int, tuple[int, float | None]] = {}
    seen_near: list[list] = []  # neighbours of each atom in the order of the text
    marks: dict[int, int] = {}
    up: dict[tuple[int, int], int] = {}  # 1: the second atom is above the first
    slant = 0

    def bond(i: int, j: int, o: float | None) -> None:
        if i == j or (min(i, j), max(i, j)) in bonds:
            raise ChemError("an atom is bonded to itself or twice")
        bonds[min(i, j), max(i, j)] = o or (1.5 if atoms[i].aromatic and atoms[j].aromatic else 1.0)

    def add(a: Atom, chiral: int = 0) -> None:
        nonlocal last, order, slant
        atoms.append(a)
        k = len(atoms) - 1
        seen_near.append([])
        if last >= 0:
            bond(last, k, order)
            seen_near[last].append(k)
            seen_near[k].append(last)
            if slant:
                up[last, k] = slant
        if a.bracket and a.h == 1:
            seen_near[k].append(-1)
        if chiral:
            marks[k] = chiral
        last, order, slant = k, None, 0

    while k < len(text):
        c = text[k]
        if c == "[":
            end = text.find("]", k)
            if end < 0:
                raise ChemError("a bracket isn't closed")
            inside = text[k + 1 : end]
            mark = inside.count("@")
            add(_bracket(inside), 0 if mark not in (1, 2) or re.search("@(TH|AL|SP|TB|OH)", inside) and "TH" not in inside else 1 if mark == 1 and "TH2" not in inside else -1)
            k = end + 1
            continue
        if text[k : k + 2] in ("Cl", "Br"):
            add(Atom(text[k : k + 2]))
            k += 2
            continue
        if c in ORGANIC or c == "*":
            add(Atom(c))
        elif c in "bcnops":
            add(Atom(AROMATIC[c], True))
        elif c in BONDS:
            if order is not None or last < 0:
                raise ChemError("a bond after a bond or without an atom")
            order, slant = BONDS[c], {"/": 1, "\\": -1}.get(c, 0)
        elif c == "(":
            if last < 0:
                raise ChemError("a branch without an atom")
            stack.append(last)
        elif c == ")":
            if not stack:
                raise ChemError("a branch isn't open")
            last = stack.pop()
        elif c == ".":
            last, order, slant = -1, None, 0
        elif c.isdigit() or c == "%":
            if c == "%":
                number, k = int(text[k + 1 : k + 3]), k + 2
            else:
                number = int(c)
            if last < 0:
                raise ChemError("a ring bond without an atom")
            if number in open_:
                other, before = open_.pop(number)
                bond(other, last, order or before)
                seen_near[other][seen_near[other].index(("ring", number))] = last
                seen_near[last].append(other)
            else:
                open_[number] = (last, order)
                seen_near[last].append(("ring", number))
            order, slant = None, 0
        else:
            raise ChemError(f"unexpected {c!r}")
        k += 1
    if open_ or stack or order is not None:
        raise ChemError("a ring, branch or bond isn't closed")
    mol = Mol(atoms, bonds)
    for i, a in enumerate(atoms):
        if not a.bracket and a.symbol != "*":
            atoms[i] = replace(a, h=_implicit(mol, i))
    centres = {i: (sign, tuple(seen_near[i])) for i, sign in marks.items() if len(seen_near[i]) in (3, 4) and len(seen_near[i]) == len(mol.near[i]) + (atoms[i].h == 1)}
    sides = {}
    for (i, j), o in bonds.items() if up else ():
        if o == 2.0:
            # where the marked neighbour of each end is, above (1) or below (-1) it
            a, b = ([(x, up[e, x] if (e, x) in up else -up[x, e]) for x in mol.near[e] if x != f and ((e, x) in up or (x, e) in up)] for e, f in ((i, j), (j, i)))
            if a and b:
                sides[i, j] = (a[0][0], b[0][0], a[0][1] * b[0][1])
    return Mol(atoms, bonds, centres, sides)


def _implicit(mol: Mol, i: int) -> int:
    a = mol.atoms[i]
    orders = list(mol.near[i].values())
    if a.aromatic:
        if a.symbol in ("O", "S"):
            return 0
        used = sum(1 if o == 1.5 else o for o in orders) + 1
        return max(0, int(ORGANIC[a.symbol][0] - used))
    used = sum(orders)
    for v in ORGANIC[a.symbol]:
        if v >= used:
            return int(v - used)
    return 0


def kekulize(mol: Mol) -> Mol:
    """Aromatic bonds as alternating single and double ones; error if there is no such pattern."""
    need = set()
    for i, a in enumerate(mol.atoms):
        if a.aromatic and not mol._lone_pair(i):
            sigma = sum(1 if o == 1.5 else o for o in mol.near[i].values()) + a.h
            top = {"C": 4, "N": 3 + max(a.charge, 0), "P": 3 + max(a.charge, 0), "B": 3, "As": 3}.get(a.symbol, 0)
            if a.symbol == "C" and a.charge > 0:
                top = 3
            if sigma < top:
                need.add(i)
    pair: dict[int, int] = {}

    def match(free: set[int]) -> bool:
        if not free:
            return True
        options = {i: [j for j, o in mol.near[i].items() if o == 1.5 and j in free] for i in free}
        i = min(free, key=lambda x: (len(options[x]), x))
        for j in options[i]:
            pair[i], pair[j] = j, i
            if match(free - {i, j}):
                return True
            del pair[i], pair[j]
        return False

    if not match(need):
        raise ChemError("aromatic atoms can't be kekulized")
    bonds = {(i, j): (2.0 if pair.get(i) == j else 1.0) if o == 1.5 else o for (i, j), o in mol.bonds.items()}
    return Mol([replace(a, aromatic=False) for a in mol.atoms], bonds, mol.centres, mol.sides)


def perceive(mol: Mol) -> Mol:
    """Aromatic rings marked, from a Kekulé or mixed graph (Hückel counts over rings and fused pairs)."""
    if any(a.aromatic for a in mol.atoms):
        mol = kekulize(mol)
    rings = mol.rings()
    inside = {i for r in rings for i in r}

    def electrons(i: int) -> int | None:
        a = mol.atoms[i]
        doubles = [j for j, o in mol.near[i].items() if o == 2.0]
        if len(doubles) > 1 or any(o > 2 for o in mol.near[i].values()):
            return None
        if doubles:
            j = doubles[0]
            if j in inside and any(i in r and j in r for r in rings):
                return 1
            return 0 if mol.atoms[j].symbol in ("O", "N", "S") and a.symbol == "C" else None
        if a.symbol in ("N", "O", "S", "P", "Se") and a.charge <= 0:
            return 2
        if a.symbol == "C" and a.charge:
            return 2 if a.charge < 0 else 0
        return 0 if a.symbol == "B" else None

    value = {i: electrons(i) for i in inside}
    aromatic: list[set[int]] = []
    plain = [set(r) for r in rings if len(r) <= 8 and all(value[i] is not None for i in r)]
    for r in plain:
        if sum(value[i] for i in r) % 4 == 2:
            aromatic.append(r)
    for x in range(len(plain)):
        for y in range(x):
            both = plain[x] | plain[y]
            if len(plain[x] & plain[y]) == 2 and sum(value[i] for i in both) % 4 == 2 and not (plain[x] in aromatic and plain[y] in aromatic):
                aromatic.append(both)
    atoms, bonds = list(mol.atoms), dict(mol.bonds)
    cycles = [frozenset(r) for r in rings]
    for group in aromatic:
        for i in group:
            atoms[i] = replace(atoms[i], aromatic=True)
        for r in cycles:
            if r <= group:
                ring = next(q for q in rings if frozenset(q) == r)
                for i, j in zip(ring, ring[1:] + ring[:1], strict=True):
                    bonds[min(i, j), max(i, j)] = 1.5
    return Mol(atoms, bonds, mol.centres, {b: x for b, x in mol.sides.items() if bonds[b] == 2.0})


def sanitize(mol: Mol) -> Mol:
    """Aromaticity perceived and valences checked; error for an impossible atom."""
    out = perceive(mol)
    flat = kekulize(out) if any(a.aromatic for a in out.atoms) else out
    for i, a in enumerate(flat.atoms):
        top = MAX_VALENCE.get(a.symbol)
        if top is None:
            continue
        if a.symbol in ("N", "P", "O", "S") and a.charge > 0:
            top += a.charge
        if a.symbol in ("C", "B") and a.charge:
            top = 4 - (abs(a.charge) if a.symbol == "C" else 0)
        if a.symbol in ("O", "N", "S") and a.charge < 0:
            top += a.charge
        if sum(flat.near[i].values()) + a.h > top:
            raise ChemError(f"the valence of {a.symbol} at {i} is too large")
    return out


def _odd(order: list) -> bool:
    """Whether an odd number of exchanges sorts the entries."""
    return sum(order[x] > order[y] for y in range(len(order)) for x in range(y)) % 2 == 1


def _stereo(mol: Mol, rank: list[int]) -> tuple[dict[int, int], dict[tuple[int, int], int]]:
    """Sign of each centre by the ranks of its neighbours, and of each double bond by those of its ends; only where like neighbours don't void it."""
    centres, sides = {}, {}
    for i, (sign, near) in mol.centres.items():
        order = [-1 if j < 0 else rank[j] for j in near]
        if len(set(order)) == len(order):
            centres[i] = -sign if _odd(order) else sign
    ring = mol.ring_bonds() if mol.sides else set()
    for (i, j), (a, b, same) in mol.sides.items():
        if frozenset((i, j)) in ring:
            continue
        for e, f, x in ((i, j, a), (j, i, b)):
            others = [y for y in mol.near[e] if y not in (f, x)]
            if others and rank[others[0]] == rank[x] or not others and mol.atoms[x].symbol == "H" and mol.atoms[e].h:
                break
            if others and rank[others[0]] > rank[x]:
                same = -same
        else:
            sides[i, j] = same
    return centres, sides


def ranks(mol: Mol) -> list[int]:
    """Canonical ranks: invariants refined by neighbours and stereochemistry, ties broken one at a time."""
    n = len(mol)
    rings = [0] * n
    for r in mol.rings():
        for i in r:
            rings[i] += 1
    keys: list = [(a.z, len(mol.near[i]), a.h, a.charge, a.isotope, a.aromatic, rings[i], a.number) for i, a in enumerate(mol.atoms)]

    def dense(values: list) -> list[int]:
        place = {v: k for k, v in enumerate(sorted(set(values)))}
        return [place[v] for v in values]

    def refined(rank: list[int]) -> list[int]:
        while True:
            new = dense([(rank[i], tuple(sorted((rank[j], o) for j, o in mol.near[i].items()))) for i in range(n)])
            if len(set(new)) == len(set(rank)):
                return rank
            rank = new

    rank = refined(dense(keys))
    while mol.centres or mol.sides:  # atoms alike but for stereochemistry
        centres, sides = _stereo(mol, rank)
        ends: dict[int, int] = {}
        for (i, j), sign in sides.items():
            ends[i] = ends[j] = sign
        new = refined(dense([(rank[i], centres.get(i, 0), ends.get(i, 0)) for i in range(n)]))
        if len(set(new)) == len(set(rank)):
            break
        rank = new
    while len(set(rank)) < n:
        tied = min(r for r in set(rank) if rank.count(r) > 1)
        first = rank.index(tied)
        rank = refined([2 * r + (r == tied and i != first) for i, r in enumerate(rank)])
    return dense(rank)


def _atom_text(mol: Mol, i: int, mark: str = "") -> str:
    a = mol.atoms[i]
    symbol = a.symbol.lower() if a.aromatic else a.symbol
    simple = a.symbol in ORGANIC and not a.charge and not a.isotope and not a.number and (not a.aromatic or a.symbol.lower() in "bcnops")
    if a.symbol == "*" and not (a.charge or a.isotope or a.h or a.number):
        return "*"
    if simple and not mark and _implicit(mol, i) == a.h:
        return symbol
    h = "" if not a.h else "H" if a.h == 1 else f"H{a.h}"
    q = "" if not a.charge else ("+" if a.charge > 0 else "-") + ("" if abs(a.charge) == 1 else str(abs(a.charge)))
    return f"[{a.isotope or ''}{symbol}{mark}{h}{q}{f':{a.number}' if a.number else ''}]"


def write(mol: Mol, rank: list[int] | None = None) -> str:
    """SMILES of the graph as it stands, atoms visited by rank."""
    return write_order(mol, rank)[0]


def write_order(mol: Mol, rank: list[int] | None = None) -> tuple[str, list[int]]:
    """The SMILES, and the atoms in the order in which it names them."""
    rank = ranks(mol) if rank is None else rank
    told, turned = _stereo(mol, _classes(mol)) if mol.centres or mol.sides else ({}, {})
    seen: set[int] = set()
    parts = []
    for comp in sorted(mol.components(), key=lambda c: min(rank[i] for i in c)):
        root = min(comp, key=lambda i: (rank[i]))
        closures: dict[int, list[tuple[int, float]]] = {}
        children: dict[int, list[int]] = {}
        parents: dict[int, int] = {root: -1}
        seen.add(root)
        todo = [(root, -1, iter(sorted(mol.near[root], key=lambda j: rank[j])))]
        children[root] = []
        open_pairs: set[frozenset[int]] = set()
        while todo:
            i, parent, it = todo[-1]
            for j in it:
                if j == parent:
                    continue
                if j in seen:
                    pair = frozenset((i, j))
                    if pair not in open_pairs:
                        open_pairs.add(pair)
                        closures.setdefault(j, []).append((i, mol.near[i][j]))
                        closures.setdefault(i, []).append((j, mol.near[i][j]))
                    continue
                seen.add(j)
                children[i].append(j)
                children[j], parents[j] = [], i
                todo.append((j, i, iter(sorted(mol.near[j], key=lambda x: rank[x]))))
                break
            else:
                todo.pop()
        numbers: dict[frozenset[int], int] = {}
        free = list(range(1, 100))
        slants = _slants(mol, turned, parents, comp, rank)

        def mark(i: int) -> str:
            if i not in told:
                return ""
            sign, near = mol.centres[i]
            text = ([parents[i]] if parents[i] >= 0 else []) + ([-1] if -1 in near else []) + [j for j, _ in closures.get(i, ())] + children[i]
            at = [near.index(j) for j in text]
            return "@" if (sign > 0) != _odd(at) else "@@"

        def sign(i: int, j: int) -> str:
            o = mol.near[i][j]
            if (i, j) in slants:
                return "/" if slants[i, j] > 0 else "\\"
            both = mol.atoms[i].aromatic and mol.atoms[j].aromatic
            if o == 1.5:
                return "" if both else ":"
            return {1.0: "-" if both else "", 2.0: "=", 3.0: "#", 4.0: "$"}[o]

        out: list[str] = []
        visited: list[int] = []
        work: list = [root]
        while work:
            x = work.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            i = x
            out.append(_atom_text(mol, i, mark(i)))
            visited.append(i)
            for j, _ in closures.get(i, ()):
                pair = frozenset((i, j))
                if pair in numbers:
                    d = numbers.pop(pair)
                    free.insert(0, d)
                    free.sort()
                    out.append(str(d) if d < 10 else f"%{d}")
                else:
                    d = free.pop(0)
                    numbers[pair] = d
                    out.append(sign(i, j) + (str(d) if d < 10 else f"%{d}"))
            kids = children[i]
            for k, j in reversed(list(enumerate(kids))):
                if k < len(kids) - 1:
                    work += [")", j, sign(i, j), "("]
                else:
                    work += [j, sign(i, j)]
        parts.append(("".join(out), visited))
    parts.sort(key=lambda p: (-len(p[0]), p[0]))
    return ".".join(p for p, _ in parts), [i for _, v in parts for i in v]


def _classes(mol: Mol) -> list[int]:
    """Ranks in which only atoms that nothing tells apart are equal: canonical ranks without the breaking of ties."""
    n = len(mol)
    rank = [0] * n
    keys: list = [(a.z, len(mol.near[i]), a.h, a.charge, a.isotope, a.aromatic, a.number) for i, a in enumerate(mol.atoms)]
    while True:
        place = {v: k for k, v in enumerate(sorted(set(keys)))}
        new = [place[k] for k in keys]
        if len(set(new)) == len(set(rank)) and any(rank):
            centres, sides = _stereo(mol, new)
            ends: dict[int, int] = {}
            for (i, j), sign in sides.items():
                ends[i] = ends[j] = sign
            keys = [(new[i], centres.get(i, 0), ends.get(i, 0)) for i in range(n)]
            if len(set(keys)) == len(set(new)):
                return new
            place = {v: k for k, v in enumerate(sorted(set(keys)))}
            new = [place[k] for k in keys]
        elif len(set(new)) == 1:
            return new
        rank = new
        keys = [(rank[i], tuple(sorted((rank[j], o) for j, o in mol.near[i].items()))) for i in range(n)]


def _slants(mol: Mol, turned: dict[tuple[int, int], int], parents: dict[int, int], comp: list[int], rank: list[int]) -> dict[tuple[int, int], int]:
    """Slant of single bonds beside double bonds, as written from parent to child: 1 for /, -1 for \\."""
    slants: dict[tuple[int, int], int] = {}
    inside = set(comp)

    def side(e: int, x: int) -> int | None:
        """Where neighbour ``x`` of ``e`` is, if the bond between them slants."""
        return slants[e, x] if (e, x) in slants else -slants[x, e] if (x, e) in slants else None

    def tilt(e: int, x: int, where: int) -> None:
        if parents.get(x) == e:
            slants[e, x] = where
        else:
            slants[x, e] = -where

    def depth(i: int) -> int:
        d = 0
        while parents.get(i, -1) >= 0:
            i, d = parents[i], d + 1
        return d

    for i, j in sorted((b for b in turned if b[0] in inside), key=lambda b: sorted((depth(k), rank[k]) for k in b)):
        a, b, same = mol.sides[i, j]
        at = []
        for e, f, x in ((i, j, a), (j, i, b)):
            tree = [y for y in mol.near[e] if y != f and (parents.get(y) == e or parents.get(e) == y)]  # ring closures don't slant
            known = [y for y in tree if side(e, y) is not None]
            at.append((known or sorted(tree, key=lambda y: (mol.atoms[y].symbol == "H", rank[y])) or [None])[0])
        if None in at:
            continue
        if at[0] != a:
            same = -same
        if at[1] != b:
            same = -same
        one, two = side(i, at[0]), side(j, at[1])
        if one is not None and two is not None:
            continue
        if one is None and two is None:
            first, other = (0, 1) if parents.get(j) == i else (1, 0)
            e, x = ((i, at[0]), (j, at[1]))[first]
            tilt(e, x, -1 if parents.get(e) == x else 1)
            one, two = side(i, at[0]), side(j, at[1])
        if one is None:
            tilt(i, at[0], same * two)
        elif two is None:
            tilt(j, at[1], same * one)
    return slants


def canonical(smiles: str) -> str:
    return write(perceive(parse(smiles)))


def add_hydrogens(mol: Mol) -> Mol:
    atoms, bonds, centres = [replace(a, h=0, bracket=True) for a in mol.atoms], dict(mol.bonds), dict(mol.centres)
    for i, a in enumerate(mol.atoms):
        for _ in range(a.h):
            bonds[i, len(atoms)] = 1.0
            atoms.append(Atom("H", bracket=True))
            if i in centres:
                centres[i] = (centres[i][0], tuple(len(atoms) - 1 if j < 0 else j for j in centres[i][1]))
    return Mol(atoms, bonds, centres, mol.sides)


def plain_hydrogens(mol: Mol) -> set[int]:
    """Hydrogen atoms that a count on their one heavy neighbour can stand for."""
    return {i for i, a in enumerate(mol.atoms) if a.symbol == "H" and not (a.charge or a.isotope or a.number) and len(mol.near[i]) == 1 and mol.atoms[next(iter(mol.near[i]))].symbol != "H"}


def remove_hydrogens(mol: Mol) -> Mol:
    """Plain hydrogen atoms on one heavy neighbour become implicit."""
    drop = plain_hydrogens(mol)
    atoms = [replace(a, h=a.h + sum(j in drop for j in mol.near[i])) for i, a in enumerate(mol.atoms)]
    return Mol(atoms, mol.bonds, mol.centres, mol.sides).part([i for i in range(len(atoms)) if i not in drop])


def largest_fragment(mol: Mol) -> Mol:
    """The component with carbon, then most heavy atoms, then mass, then the least SMILES."""
    from .props import average_mass

    def worth(keep: list[int]) -> tuple:
        p = mol.part(keep)
        return (not any(a.symbol == "C" for a in p.atoms), -sum(a.symbol != "H" for a in p.atoms), -average_mass(p), write(p))

    parts = mol.components()
    return mol if len(parts) < 2 else mol.part(min(parts, key=worth))

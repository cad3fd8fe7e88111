"""Connection tables: V2000, and V3000 where counts need more than three digits."""

from __future__ import annotations

from ..functions.chem import mol as M


def read_block(block: str) -> tuple[M.Mol, list[list[float]], str]:
    """(graph, coordinates, name) of a mol block."""
    lines = block.replace("\r", "").split("\n")
    if len(lines) < 4:
        raise M.ChemError("the block is too short")
    name, counts = lines[0].strip(), lines[3]
    if counts.rstrip().endswith("V3000"):
        atoms, bonds, coords = _read_v3000(lines[4:])
        return _graph(atoms, bonds), coords, name
    try:
        n, m = int(counts[:3]), int(counts[3:6])
        rows = lines[4 : 4 + n]
        coords = [[float(r[0:10]), float(r[10:20]), float(r[20:30])] for r in rows]
        symbols = [r[31:34].strip() for r in rows]
        old = [{0: 0, 1: 3, 2: 2, 3: 1, 5: -1, 6: -2, 7: -3}.get(int(r[36:39] or 0), 0) for r in rows]
        bonds = {}
        for r in lines[4 + n : 4 + n + m]:
            i, j, o = int(r[:3]) - 1, int(r[3:6]) - 1, int(r[6:9])
            bonds[min(i, j), max(i, j)] = {1: 1.0, 2: 2.0, 3: 3.0, 4: 1.5}[o]
    except (ValueError, KeyError, IndexError) as e:
        raise M.ChemError(f"can't read the connection table: {e}") from e
    if len(rows) < n or any(s not in M.NUMBER for s in symbols):
        raise M.ChemError("the connection table is cut off or has an unknown element")
    charge, mass = dict(enumerate(old)), {}
    for line in lines[4 + n + m :]:
        if line.startswith(("M  CHG", "M  ISO")):
            parts = line[6:].split()[1:]
            (charge if line[3] == "C" else mass).update({int(a) - 1: int(q) for a, q in zip(parts[::2], parts[1::2], strict=True)})
        if line.startswith("M  END"):
            break
    return _graph([(x, charge.get(i, 0), mass.get(i, 0)) for i, x in enumerate(symbols)], bonds), coords, name


def _graph(found: list[tuple[str, int, int]], bonds: dict[tuple[int, int], float]) -> M.Mol:
    """The graph of atoms (symbol, charge, isotope), with hydrogens filled in."""
    ring = {i for b, o in bonds.items() if o == 1.5 for i in b}
    atoms = [M.Atom(s, i in ring, q, iso, bracket=True) for i, (s, q, iso) in enumerate(found)]
    graph = M.Mol(atoms, bonds)
    for i, a in enumerate(atoms):
        if a.symbol in M.ORGANIC:
            shift = a.charge if a.symbol in ("N", "O", "S", "P") else -abs(a.charge)
            used = sum(graph.near[i].values())
            if i in ring:
                h = M._implicit(graph, i)
            else:
                h = next((int(v + shift - used) for v in M.ORGANIC[a.symbol] if v + shift >= used), 0)
            atoms[i] = M.replace(a, h=max(0, h))
    return M.Mol(atoms, bonds)


def _read_v3000(lines: list[str]) -> tuple[list, dict, list]:
    rows: list[str] = []
    more = False
    for line in lines:
        if line.startswith("M  END"):
            break
        if not line.startswith("M  V30 "):
            continue
        text = line[7:]
        rows.append((rows.pop() if more else "") + text.rstrip("-"))
        more = text.endswith("-")
    atoms, bonds, coords, place, part = [], {}, [], {}, ""
    try:
        for row in rows:
            words = row.split()
            if words[:1] in (["BEGIN"], ["END"]):
                part = words[1] if words[0] == "BEGIN" else ""
            elif part == "ATOM":
                place[words[0]] = len(atoms)
                extra = dict(w.split("=", 1) for w in words[6:] if "=" in w)
                if words[1] not in M.NUMBER:
                    raise M.ChemError(f"unknown element {words[1]}")
                atoms.append((words[1], int(extra.get("CHG", 0)), int(extra.get("MASS", 0))))
                coords.append([float(x) for x in words[2:5]])
            elif part == "BOND":
                i, j = place[words[2]], place[words[3]]
                bonds[min(i, j), max(i, j)] = {1: 1.0, 2: 2.0, 3: 3.0, 4: 1.5}[int(words[1])]
    except (ValueError, KeyError, IndexError) as e:
        raise M.ChemError(f"can't read the connection table: {e}") from e
    return atoms, bonds, coords


def block_format(mol: M.Mol) -> str:
    """A V2000 block, or V3000 from 1,000 atoms or bonds on, without its name: a format of all atoms' coordinates."""
    flat = M.kekulize(mol) if any(a.aromatic for a in mol.atoms) else mol
    if max(len(flat), len(flat.bonds)) > 999:
        out = ["", "  retort", "", "  0  0  0     0  0            999 V3000", "M  V30 BEGIN CTAB", f"M  V30 COUNTS {len(flat)} {len(flat.bonds)} 0 0 0", "M  V30 BEGIN ATOM"]
        for i, a in enumerate(flat.atoms, 1):
            out.append(f"M  V30 {i} {a.symbol} {{:.4f}} {{:.4f}} {{:.4f}} 0" + (f" CHG={a.charge}" if a.charge else "") + (f" MASS={a.isotope}" if a.isotope else ""))
        out += ["M  V30 END ATOM", "M  V30 BEGIN BOND", *[f"M  V30 {k} {int(o)} {i + 1} {j + 1}" for k, ((i, j), o) in enumerate(sorted(flat.bonds.items()), 1)], "M  V30 END BOND", "M  V30 END CTAB"]
        return "\n".join([*out, "M  END"])
    out = ["", "  retort", "", f"{len(flat):3d}{len(flat.bonds):3d}  0  0  0  0  0  0  0  0999 V2000"]
    for a in flat.atoms:
        out.append(f"{{:10.4f}}{{:10.4f}}{{:10.4f}} {a.symbol:<3} 0  0  0  0  0  0  0  0  0  0  0  0")
    out += [f"{i + 1:3d}{j + 1:3d}{int(o):3d}  0" for (i, j), o in sorted(flat.bonds.items())]
    for tag, values in (("CHG", [(i, a.charge) for i, a in enumerate(flat.atoms, 1) if a.charge]), ("ISO", [(i, a.isotope) for i, a in enumerate(flat.atoms, 1) if a.isotope])):
        for k in range(0, len(values), 8):
            part = values[k : k + 8]
            out.append(f"M  {tag}{len(part):3d}" + "".join(f"{i:4d}{q:4d}" for i, q in part))
    return "\n".join([*out, "M  END"])


def write_block(mol: M.Mol, name: str = "", coords: list[list[float]] | None = None) -> str:
    """A block; ``coords`` are by atom, zeros without them."""
    if coords is not None and len(coords) != len(mol):
        raise M.ChemError("there must be coordinates for each atom")
    return name + block_format(mol).format(*[v for x, y, z in coords or [(0.0, 0.0, 0.0)] * len(mol) for v in (x, y, z)])

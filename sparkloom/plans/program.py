"""Typed dataflow programs: genomes of integers, the steps that they decode to, and Spark columns compiled from steps.

A program is evaluated as columns over a DataFrame of samples. Equal sub-programs, of one individual or of a whole
population, become one intermediate column.
"""

from __future__ import annotations

import hashlib
import json
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions  # noqa: F401  registers the operators
from ..registry import REGISTRY, SPARK_TYPES, EngineConf, OpSpec, Registry

#: Families that work in pandas UDFs, which Spark allows in no lambda of a later step.
OWN_COLUMN = {"binarize", "image_graph", "image_windows"}


@dataclass(frozen=True)
class Input:
    column: str
    type: str


@dataclass(frozen=True)
class Constant:
    value: object
    type: str


@dataclass(frozen=True, eq=False)
class Call:
    """An operator applied to nodes; nodes compare by structure, in time linear in their distinct steps."""

    op: str
    args: tuple
    type: str = "any"

    def __post_init__(self) -> None:
        # Worked out once, from the hashes of the arguments: programs may share sub-programs at every step.
        object.__setattr__(self, "_hash", hash((self.op, self.args, self.type)))

    def __hash__(self) -> int:
        return self._hash

    def __eq__(self, other: object) -> bool:
        if self is other or not isinstance(other, Call) or self._hash != other._hash:
            return self is other
        mine, theirs = Sharing().rebuild([self, other])
        return mine is theirs

    def __reduce__(self):
        return Call, (self.op, self.args, self.type)


Node = Input | Constant | Call


def type_of(node: Node) -> str:
    return node.type


def call(op: str, *args: Node, registry: Registry = REGISTRY) -> Call:
    """A typed call; the type follows from the operator, for "any" from the first argument of that kind."""
    spec = registry.resolve(op, [a.type for a in args])
    kind = spec.returns
    if kind in ("any", "list", "number", "list<number>", "pairs"):
        like = [a.type for p, a in zip(spec.params, args, strict=False) if p == kind]
        kind = like[-1] if like else {"list": "list<float>", "number": "float", "list<number>": "list<float>", "pairs": "pairs<float>"}.get(kind, "float")
    return Call(op, tuple(args), kind)


def steps(outputs: Sequence[Node]) -> list[Call]:
    """The distinct calls that the outputs need, each after its arguments; nothing else is evaluated."""
    seen: dict[Call, None] = {}
    todo: list[tuple[Node, bool]] = [(n, False) for n in reversed(outputs)]
    while todo:
        node, ready = todo.pop()
        if not isinstance(node, Call) or node in seen:
            continue
        if ready:
            seen[node] = None
        else:
            todo.append((node, True))
            todo += [(a, False) for a in reversed(node.args)]
    return list(seen)


class Sharing:
    """One object for each distinct node, so that programs that share much compare, compile and expand in time linear in their steps."""

    def __init__(self):
        self.nodes: dict[tuple, Node] = {}

    def one(self, node: Node) -> Node:
        """The object of a node whose arguments are such objects."""
        parts = (node.op, node.type, *map(id, node.args)) if isinstance(node, Call) else (type(node), repr(node))
        return self.nodes.setdefault(parts, node)

    def rebuild(self, outputs: Sequence[Node], change: Callable[[Call, tuple], Node] = lambda c, args: Call(c.op, args, c.type), leaf: Callable[[Node], Node] = lambda n: n) -> list[Node]:
        """The outputs with each call made anew, after its arguments, by change(call, new arguments), and inputs and constants by leaf."""
        done: dict[int, Node] = {}
        todo: list[tuple[Node, bool]] = [(n, False) for n in reversed(outputs)]
        while todo:
            node, ready = todo.pop()
            if id(node) in done:
                continue
            if not isinstance(node, Call):
                done[id(node)] = self.one(leaf(node))
            elif ready:
                done[id(node)] = self.one(change(node, tuple(done[id(a)] for a in node.args)))
            else:
                todo.append((node, True))
                todo += [(a, False) for a in reversed(node.args)]
        return [done[id(n)] for n in outputs]


def render(outputs: Sequence[Node]) -> str:
    """The steps as text, one line each."""
    outputs = Sharing().rebuild(outputs)
    names: dict[Node, str] = {}
    show = lambda n: names[n] if n in names else n.column if isinstance(n, Input) else repr(n.value)
    lines = []
    for k, c in enumerate(steps(outputs), 1):
        lines.append(f"t{k} = {c.op}({', '.join(show(a) for a in c.args)})")
        names[c] = f"t{k}"
    return "\n".join([*lines, *[f"out{k} = {show(o)}" for k, o in enumerate(outputs, 1)]])


def project(df: DataFrame, outputs: dict[str, Node], registry: Registry = REGISTRY, conf: EngineConf | None = None, fallbacks: dict[str, object] | None = None) -> DataFrame:
    """df with one column per output. Calls used more than once, and Python UDFs, are columns of their own, level by level; the rest nests."""
    def resolve(c: str, types: Sequence[str]) -> OpSpec:
        """The catalogue's own operators stand in where a smaller one lacks what its operators are written by."""
        try:
            return registry.resolve(c, types)
        except LookupError:
            return REGISTRY.resolve(c, types)

    def lowered(c: Call, args: tuple) -> Node:
        spec = resolve(c.op, [a.type for a in args])
        return Call(c.op, args, c.type) if spec.lower is None else sharing.rebuild([spec.lower(args)])[0]

    sharing = Sharing()
    roots = sharing.rebuild(list(outputs.values()), lowered)
    outputs = dict(zip(outputs, roots, strict=True))
    order = steps(roots)
    uses: dict[Node, int] = {}
    for c in order:
        for a in c.args:
            uses[a] = uses.get(a, 0) + 1
    for r in roots:
        uses[r] = uses.get(r, 0) + 1
    # What goes into a Python UDF stays a column: Spark moves it into the UDF's arguments otherwise, and loses a UDF over nested lambdas.
    kept = {a for c in order if resolve(c.op, [x.type for x in c.args]).family in OWN_COLUMN for a in c.args if isinstance(a, Call)}
    built: dict[Node, Column] = {}
    names: dict[Node, str] = {}
    depth: dict[Node, int] = {}
    levels: list[dict[str, Column]] = []

    def column(n: Node) -> Column:
        if n in names:
            return F.col(names[n])
        if isinstance(n, Input):
            return F.col(n.column)
        if isinstance(n, Constant):
            return F.lit(n.value).cast(SPARK_TYPES.get(n.type, "string"))
        return built[n]

    for k, c in enumerate(order):
        spec = resolve(c.op, [a.type for a in c.args])
        out = spec.column([column(a) for a in c.args], conf)
        if fallbacks and spec.fallback is None and spec.returns in fallbacks:
            out = F.coalesce(out, F.lit(fallbacks[spec.returns]))
        level = max((depth.get(a, 0) for a in c.args), default=0)
        if c in kept:
            out = F.when(F.monotonically_increasing_id() >= 0, out)
        if uses[c] > 1 or spec.family in OWN_COLUMN or c in kept:
            names[c] = f"__t{k}"
            while len(levels) <= level:
                levels.append({})
            levels[level][names[c]] = out
            level += 1
        built[c], depth[c] = out, level
    made = df
    for columns in levels:
        if columns:
            made = made.withColumns(columns)
    return made.withColumns({k: column(n) for k, n in outputs.items()}).drop(*names.values())


def dump_nodes(outputs: Sequence[Node]) -> str:
    """Programs as JSON: the distinct nodes in order, each call with the numbers of its arguments, then the outputs' numbers."""
    outputs = Sharing().rebuild(outputs)
    numbers: dict[int, int] = {}
    rows: list[list] = []

    def number(n: Node, row: list) -> None:
        numbers[id(n)] = len(rows)
        rows.append(row)

    leaves = [a for c in steps(outputs) for a in c.args if not isinstance(a, Call)] + [o for o in outputs if not isinstance(o, Call)]
    for n in leaves:
        if id(n) not in numbers:
            number(n, ["in", n.column, n.type] if isinstance(n, Input) else ["const", n.value, n.type])
    for c in steps(outputs):
        number(c, ["call", c.op, [numbers[id(a)] for a in c.args], c.type])
    return json.dumps([rows, [numbers[id(o)] for o in outputs]])


def load_nodes(text: str) -> list[Node]:
    rows, outputs = json.loads(text)
    made: list[Node] = []
    for kind, *rest in rows:
        made.append(Input(*rest) if kind == "in" else Constant(*rest) if kind == "const" else Call(rest[0], tuple(made[k] for k in rest[1]), rest[2]))
    return [made[k] for k in outputs]


# ---- genomes


@dataclass(frozen=True)
class Architecture:
    """Inputs (column, type), chromosomes (one value type each), outputs (their chromosome)."""

    inputs: tuple[tuple[str, str], ...]
    chromosomes: tuple[str, ...]
    outputs: tuple[int, ...]
    nodes: int = 10
    arity: int = 3
    registry: Registry = field(default=REGISTRY, compare=False)
    #: Outputs stay at the last positions, the first output at the very last, and no mutation moves them.
    frozen: bool = False

    def operators(self, kind: str) -> list[OpSpec]:
        """The operators of a chromosome, in order of name."""
        return [s for n in sorted(self.registry.ops) for s in self.registry.ops[n] if s.returns == kind and len(s.params) <= self.arity]


@dataclass(frozen=True)
class Genome:
    """nodes[chromosome][position] = (operator, (position, type) x arity); outputs = positions. Positions below the number of inputs are inputs."""

    nodes: tuple
    outputs: tuple

    def key(self) -> str:
        return hashlib.sha256(self.dump().encode()).hexdigest()

    def dump(self) -> str:
        return json.dumps([self.nodes, self.outputs])

    @staticmethod
    def load(text: str) -> Genome:
        deep = lambda x: tuple(map(deep, x)) if isinstance(x, list) else x
        return Genome(*map(deep, json.loads(text)))


def random_node(arch: Architecture, chromosome: int, position: int, rng: random.Random) -> tuple:
    before = len(arch.inputs) + position
    ops = arch.operators(arch.chromosomes[chromosome])
    return (rng.randrange(len(ops)), *[(rng.randrange(before), rng.randrange(len(arch.chromosomes))) for _ in range(arch.arity)])


def random_genome(arch: Architecture, rng: random.Random) -> Genome:
    nodes = tuple(tuple(random_node(arch, c, p, rng) for p in range(arch.nodes)) for c in range(len(arch.chromosomes)))
    n = len(arch.inputs) + arch.nodes
    outputs = last_positions(arch) if arch.frozen else tuple(rng.randrange(n) for _ in arch.outputs)
    return correct(arch, Genome(nodes, outputs), rng)


def last_positions(arch: Architecture) -> tuple[int, ...]:
    """Where frozen outputs point: the k-th to the k-th last position."""
    n = len(arch.inputs) + arch.nodes
    if len(arch.outputs) > arch.nodes:
        raise ValueError("more outputs than nodes")
    return tuple(n - 1 - k for k in range(len(arch.outputs)))


def decode(arch: Architecture, genome: Genome) -> list[Node]:
    """The outputs as nodes. Where no overload takes the arguments' types, the first input or constant of the type stands in."""
    known: dict[tuple[int, int], Node] = {}

    def at(position: int, chromosome: int) -> Node:
        if position < len(arch.inputs):
            return Input(*arch.inputs[position])
        if (position, chromosome) not in known:
            kind = arch.chromosomes[chromosome]
            gene = genome.nodes[chromosome][position - len(arch.inputs)]
            spec = arch.operators(kind)[gene[0]]
            args = tuple(at(p, c) for p, c in gene[1 : 1 + len(spec.params)])
            known[position, chromosome] = Call(spec.name, args, kind) if spec.fits([a.type for a in args]) else missing(arch, kind)
        return known[position, chromosome]

    found = [at(p, c) for p, c in zip(genome.outputs, arch.outputs, strict=True)]
    return [n if n.type == arch.chromosomes[c] else missing(arch, arch.chromosomes[c]) for n, c in zip(found, arch.outputs, strict=True)]


def missing(arch: Architecture, kind: str) -> Node:
    return next((Input(c, t) for c, t in arch.inputs if t == kind), Constant({"int": 0, "float": 0.0, "bool": False, "string": ""}.get(kind), kind))


def correct(arch: Architecture, genome: Genome, rng: random.Random, tries: int = 200) -> Genome:
    """Draw again nodes whose arguments no overload takes."""
    nodes = [list(c) for c in genome.nodes]
    for position in range(arch.nodes):
        for c, kind in enumerate(arch.chromosomes):
            for _ in range(tries):
                spec = arch.operators(kind)[nodes[c][position][0]]
                types = [arch.inputs[p][1] if p < len(arch.inputs) else arch.chromosomes[t] for p, t in nodes[c][position][1:]]
                if spec.fits(types):
                    break
                nodes[c][position] = random_node(arch, c, position, rng)
    return Genome(tuple(map(tuple, nodes)), genome.outputs)


def active(arch: Architecture, genome: Genome) -> set[tuple[int, int]]:
    """(chromosome, position) of the nodes that the outputs reach."""
    seen, todo = set(), list(zip(genome.outputs, arch.outputs, strict=True))
    while todo:
        p, c = todo.pop()
        if p >= len(arch.inputs) and (c, p - len(arch.inputs)) not in seen:
            seen.add((c, p - len(arch.inputs)))
            gene = genome.nodes[c][p - len(arch.inputs)]
            todo += gene[1 : 1 + len(arch.operators(arch.chromosomes[c])[gene[0]].params)]
    return seen


def mutate(arch: Architecture, genome: Genome, rng: random.Random, n: int = 1, output_rate: float = 0.1, new_material: bool = True) -> Genome:
    """Draw n active nodes anew, and each output with output_rate; with new_material until what is active has changed."""
    for _ in range(50):
        nodes = [list(c) for c in genome.nodes]
        reached = sorted(active(arch, genome))
        for c, p in rng.sample(reached, min(n, len(reached))):
            nodes[c][p] = random_node(arch, c, p, rng)
        outputs = _outputs(arch, genome, rng, output_rate)
        child = correct(arch, Genome(tuple(map(tuple, nodes)), outputs), rng)
        if not new_material or decode(arch, child) != decode(arch, genome):
            return child
    return child


def _outputs(arch: Architecture, genome: Genome, rng: random.Random, rate: float) -> tuple[int, ...]:
    if arch.frozen:
        return genome.outputs
    return tuple(rng.randrange(len(arch.inputs) + arch.nodes) if rng.random() < rate else o for o in genome.outputs)


def _alleles(arch: Architecture, chromosome: int, position: int) -> list[int]:
    """How many values each allele of a node can take: its operator, then position and chromosome of each argument."""
    return [len(arch.operators(arch.chromosomes[chromosome])), *[len(arch.inputs) + position, len(arch.chromosomes)] * arch.arity]


def _flat(node: tuple) -> list[int]:
    return [node[0], *[x for pair in node[1:] for x in pair]]


def _node(alleles: Sequence[int]) -> tuple:
    return (alleles[0], *[(alleles[k], alleles[k + 1]) for k in range(1, len(alleles), 2)])


def free_mutate(arch: Architecture, genome: Genome, rng: random.Random, rate: float = 0.1, changes: int = 1000) -> Genome:
    """Each node, active or not, changes with a rate: alleles are drawn one at a time until it differs. Whether its operator takes the arguments isn't asked."""
    nodes = []
    for c, genes in enumerate(genome.nodes):
        row = []
        for p, node in enumerate(genes):
            if rng.random() < rate:
                ranges, alleles = _alleles(arch, c, p), _flat(node)
                for _ in range(changes):
                    if _node(alleles) != node:
                        break
                    k = rng.randrange(len(alleles))
                    alleles[k] = rng.randrange(ranges[k])
                node = _node(alleles)
            row.append(node)
        nodes.append(tuple(row))
    return Genome(tuple(nodes), genome.outputs)


def mutate_alleles(arch: Architecture, genome: Genome, rng: random.Random, rate: float = 0.1, output_rate: float = 0.1) -> Genome:
    """Every allele of every node is drawn anew with the same rate, then nodes whose arguments no overload takes are drawn again."""
    nodes = tuple(tuple(_node([rng.randrange(n) if rng.random() < rate else a for a, n in zip(_flat(node), _alleles(arch, c, p), strict=True)]) for p, node in enumerate(genes)) for c, genes in enumerate(genome.nodes))
    return correct(arch, Genome(nodes, _outputs(arch, genome, rng, output_rate)), rng)


def crossover(a: Genome, b: Genome, rng: random.Random) -> tuple[Genome, Genome]:
    """Swap at least one and not all chromosomes; with a single one, its halves."""
    n = len(a.nodes)
    if n == 1:
        cut = rng.randrange(1, max(2, len(a.nodes[0])))
        return (replace(a, nodes=(a.nodes[0][:cut] + b.nodes[0][cut:],)), replace(b, nodes=(b.nodes[0][:cut] + a.nodes[0][cut:],)))
    swapped = set(rng.sample(range(n), rng.randint(1, n - 1)))
    pick = lambda x, y: tuple(y.nodes[i] if i in swapped else x.nodes[i] for i in range(n))
    return replace(a, nodes=pick(a, b)), replace(b, nodes=pick(b, a))


functions.windows.register()

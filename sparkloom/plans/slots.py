"""Slots: operators of a catalogue whose bodies are programs, put in and replaced while genomes go on calling them by name.

A slot is reserved with a type, and is the identity until a program is put in. Bodies may call other slots, never
themselves. Before Spark sees a program its slot calls are expanded: bodies take the place of the calls, with the
arguments for their inputs, and equal calls share one object at every depth, so that each becomes one column.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import REGISTRY, SPARK_TYPES, EngineConf, OpSpec, Registry
from . import program
from .program import Architecture, Call, Constant, Genome, Input, Node, Sharing, active, decode, render, steps

FAMILY = "slots"


class SlotError(ValueError):
    """A slot that isn't there, is in use, or would call itself."""


@dataclass(frozen=True)
class Slot:
    """An operator by name; params are the types of the inputs, whose columns in the body are in1, in2, ...; fixed ones are never replaced."""

    name: str
    params: tuple[str, ...]
    returns: str
    body: Node | None = None
    title: str = ""
    fixed: bool = False

    @property
    def empty(self) -> bool:
        return self.body is None

    def source(self) -> str:
        """The body as text."""
        return "reserved: the identity of its first input" if self.empty else render([self.body])


def formal(k: int, kind: str) -> Input:
    """The k-th input of a body, from 1."""
    return Input(f"in{k}", kind)


class Slots:
    """The slots of one run, and the catalogue that holds them beside the operators of ``base``."""

    def __init__(self, base: Registry = REGISTRY):
        self.registry = Registry({name: list(specs) for name, specs in base.ops.items()})
        self.slots: dict[str, Slot] = {}

    # -- reserving and replacing

    def _put(self, slot: Slot) -> Slot:
        if slot.name not in self.slots and slot.name in self.registry.ops:
            raise SlotError(f"{slot.name} is an operator already")
        self.slots[slot.name] = slot
        self.registry.ops[slot.name] = [OpSpec(slot.name, FAMILY, slot.params, slot.returns, lambda *args, name=slot.name: self._column(name, args), doc=slot.source())]
        return slot

    def reserve(self, returns: str, how_many: int = 1, prefix: str = "adf") -> list[str]:
        """New empty slots of a type: prefix_1, prefix_2, ..., after those that are there. Their names and types stay, whatever is put in."""
        if how_many < 0:
            raise SlotError("can't reserve fewer than no slots")
        first = 1 + max((int(n.rpartition("_")[2]) for n in self.slots if n.rpartition("_")[0] == prefix and n.rpartition("_")[2].isdigit()), default=0)
        return [self._put(Slot(f"{prefix}_{k}", (returns,), returns)).name for k in range(first, first + how_many)]

    def put(self, name: str, body: Node, inputs: Sequence[Input], title: str = "", population: Iterable[Sequence[Node]] = (), fixed: bool = False) -> Slot:
        """Put a program in: ``inputs`` become the parameters in their order.

        Refused: an unknown slot (but for a fixed one, which is new), a fixed one, one that the population or another slot
        uses, a body of another type, with an input that isn't named, without inputs, with an unknown slot or operator, or
        one that calls the slot itself over any number of slots.
        """
        known = self.slots.get(name)
        if known is None and not fixed:
            raise SlotError(f"{name} isn't reserved")
        if known is not None and (known.fixed or not self.replaceable(name, population)):
            raise SlotError(f"{name} is in use")
        if known is not None and body.type != known.returns:
            raise SlotError(f"{name} returns {known.returns}, the program {body.type}")
        if not inputs or len({i.column for i in inputs}) < len(inputs):
            raise SlotError("a body has at least one input, and each once")
        numbers = {i: formal(k, i.type) for k, i in enumerate(inputs, 1)}
        sharing = Sharing()

        def leaf(n: Node) -> Node:
            if isinstance(n, Input) and n not in numbers:
                raise SlotError(f"{n.column} isn't among the inputs")
            return numbers.get(n, n) if isinstance(n, Input) else n

        body = sharing.rebuild([body], leaf=leaf)[0]
        for c in steps([body]):
            if c.op == name or name in self.closure(c.op):
                raise SlotError(f"{name} would call itself")
            self.registry.resolve(c.op, [a.type for a in c.args])
        return self._put(Slot(name, tuple(i.type for i in inputs), body.type, body, title or (known.title if known else ""), fixed))

    def put_genome(self, name: str, arch: Architecture, genome: Genome, title: str = "", population: Iterable[Sequence[Node]] = ()) -> Slot:
        """Put in what a genome of one output decodes to; the inputs of its architecture are the parameters."""
        outputs = decode(arch, genome)
        if len(outputs) != 1:
            raise SlotError("a slot takes a program of one output")
        return self.put(name, outputs[0], [Input(*i) for i in arch.inputs], title, population)

    def define(self, name: str, body: Node, inputs: Sequence[Input], title: str = "") -> Slot:
        """A fixed operator made of a program."""
        if name in self.slots:
            raise SlotError(f"{name} is there already")
        return self.put(name, body, inputs, title, fixed=True)

    # -- use

    def used(self, outputs: Iterable[Node]) -> set[str]:
        """The slots that programs call themselves."""
        return {c.op for c in steps(list(outputs)) if c.op in self.slots}

    def dependencies(self, name: str) -> set[str]:
        """The slots that a slot's body calls itself."""
        slot = self.slots.get(name)
        return set() if slot is None or slot.empty else self.used([slot.body])

    def closure(self, name: str) -> set[str]:
        """All slots that a slot reaches."""
        found: set[str] = set()
        todo = [name]
        while todo:
            new = self.dependencies(todo.pop()) - found
            found |= new
            todo += new
        return found

    def users(self, name: str) -> set[str]:
        """The slots that reach a slot."""
        return {n for n in self.slots if name in self.closure(n)}

    def replaceable(self, name: str, population: Iterable[Sequence[Node]] = ()) -> bool:
        """Neither an individual nor another slot uses it."""
        return not self.users(name) and all(name not in self.used(outputs) for outputs in population)

    def in_order(self) -> list[Slot]:
        """The slots, each after those that it calls."""
        out: dict[str, None] = {}

        def visit(name: str) -> None:
            for n in sorted(self.dependencies(name) - set(out)):
                visit(n)
            out.setdefault(name)

        for name in sorted(self.slots):
            visit(name)
        return [self.slots[n] for n in out]

    # -- programs without slots

    def expand(self, outputs: Sequence[Node], depth: int | None = None, sharing: Sharing | None = None) -> list[Node]:
        """The programs with the bodies of slots in place of their calls; with ``depth`` only so many levels of them. Empty slots give their first argument."""
        sharing = sharing or Sharing()
        bodies: dict[tuple, Node] = {}

        def body(name: str, level: int | None) -> Node:
            if (name, level) not in bodies:
                bodies[name, level] = at([self.slots[name].body], level)[0]
            return bodies[name, level]

        def at(nodes: Sequence[Node], level: int | None) -> list[Node]:
            if level is not None and level <= 0:
                return sharing.rebuild(nodes)

            def change(c: Call, args: tuple) -> Node:
                slot = self.slots.get(c.op)
                if slot is None:
                    return Call(c.op, args, c.type)
                if slot.empty:
                    return args[0]
                given = {formal(k, t): a for k, (t, a) in enumerate(zip(slot.params, args, strict=False), 1)}
                return sharing.rebuild([body(c.op, None if level is None else level - 1)], leaf=lambda n: given.get(n, n) if isinstance(n, Input) else n)[0]

            return sharing.rebuild(nodes, change)

        return at(outputs, depth)

    def project(self, df: DataFrame, outputs: Mapping[str, Node], conf: EngineConf | None = None, fallbacks: dict[str, object] | None = None) -> DataFrame:
        """df with a column for each output, slots expanded first."""
        made = self.expand(list(outputs.values()))
        return program.project(df, dict(zip(outputs, made, strict=True)), self.registry, conf, fallbacks)

    def _column(self, name: str, args: Sequence[Column]) -> Column:
        """A slot as a column of its arguments' columns, for callers that don't expand."""
        slot = self.slots[name]
        if slot.empty:
            return args[0]
        built: dict[int, Column] = {}
        body = self.expand([slot.body])[0]

        def column(n: Node) -> Column:
            if isinstance(n, Input):
                return args[int(n.column[2:]) - 1]
            return F.lit(n.value).cast(SPARK_TYPES.get(n.type, "string")) if isinstance(n, Constant) else built[id(n)]

        for c in steps([body]):
            built[id(c)] = self.registry.resolve(c.op, [a.type for a in c.args]).column([column(a) for a in c.args])
        return column(body)

    # -- genomes without slots

    def flatten(self, arch: Architecture, genome: Genome, depth: int | None = None) -> tuple[Architecture, Genome]:
        """A wider genome in which the bodies' steps stand before each active slot call, and the call's gene is the body's last step.

        Genes that nothing reaches are kept, moved along. ``depth`` is the most calls that are flattened. Refused: a body
        with a constant, or an operator with more parameters than genes have arguments.
        """
        done = 0
        while depth is None or done < depth:
            found = next(((p, c) for c, p in sorted(active(arch, genome), key=lambda x: (x[1], x[0])) if self._called(arch, genome, c, p)), None)
            if found is None:
                break
            arch, genome = self._flatten_one(arch, genome, *found)
            done += 1
        return arch, genome

    def _called(self, arch: Architecture, genome: Genome, chromosome: int, position: int) -> bool:
        return arch.operators(arch.chromosomes[chromosome])[genome.nodes[chromosome][position][0]].name in self.slots

    def _flatten_one(self, arch: Architecture, genome: Genome, position: int, chromosome: int) -> tuple[Architecture, Genome]:
        n, gene = len(arch.inputs), genome.nodes[chromosome][position]
        slot = self.slots[arch.operators(arch.chromosomes[chromosome])[gene[0]].name]
        body = formal(1, slot.returns) if slot.empty else slot.body
        calls = steps([body])
        width = max(len(calls) - 1, 0)
        moved = lambda p: p + width if p >= n + position else p
        places: dict[int, tuple[int, int]] = {}

        def place(node: Node) -> tuple[int, int]:
            if isinstance(node, Constant):
                raise SlotError("genes hold no constants")
            return gene[int(node.column[2:])] if isinstance(node, Input) else places[id(node)]

        def gene_of(c: Call) -> tuple:
            types = [a.type for a in c.args]
            k = next((k for k, s in enumerate(arch.operators(c.type)) if s.name == c.op and s.fits(types)), None)
            if k is None or len(c.args) > arch.arity:
                raise SlotError(f"genes can't hold {c.op}")
            args = [place(a) for a in c.args]
            return (k, *args, *[args[0] if args else (0, 0)] * (arch.arity - len(args)))

        written: dict[tuple[int, int], tuple] = {}
        for k, c in enumerate(calls):
            if c.type not in arch.chromosomes:
                raise SlotError(f"no chromosome of {c.type}")
            to = arch.chromosomes.index(c.type) if k < len(calls) - 1 else chromosome
            written[to, position + k] = gene_of(c)
            places[id(c)] = (n + position + k, to)
        nodes = []
        for c, genes in enumerate(genome.nodes):
            before = list(genes[:position])
            # What fills the gap elsewhere only points to inputs, as the first gene does.
            gap = [written.get((c, position + k), genes[0]) for k in range(width)]
            after = [(g[0], *[(moved(p), t) for p, t in g[1:]]) for g in genes[position:]]
            if c == chromosome and calls:
                after[0] = written[chromosome, position + width]
            nodes.append((*before, *gap, *after))
        outputs = [moved(p) for p in genome.outputs]
        if not calls:  # the identity: what pointed to the call points to its argument
            at, to = (n + position, chromosome), place(body)
            nodes = [tuple((g[0], *[to if (p, t) == at else (p, t) for p, t in g[1:]]) for g in genes) for genes in nodes]
            if to[0] >= n and to[1] != chromosome:
                raise SlotError("an output can't move to another chromosome")
            outputs = [to[0] if p == at[0] and t == chromosome else p for p, t in zip(outputs, arch.outputs, strict=True)]
        return replace(arch, nodes=arch.nodes + width), Genome(tuple(nodes), tuple(outputs))

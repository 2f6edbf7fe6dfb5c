"""Parent-child rows of unknown depth: root, depth, path and descendants of every node, with cycle detection.

1. Contraction: as long as it removes at least half of the nodes left, all leaves are cut off in a round and their sizes are
   added to their parents. Wide and shallow trees are gone after a few rounds, whatever their number of children.
2. Doubling of what is left, the deep parts: every node jumps to its 2nd, 4th, 8th ... ancestor. Nodes that never run out of
   ancestors hang on a cycle; those among them that other such nodes still jump to are on it. The same rounds add up subtree
   sizes, as the descendants within 2^(k+1) steps are those within 2^k steps plus those of the nodes 2^k steps below.
   Nodes on a cycle are taken for roots from here on, so that what is below a cycle is a tree like any other.
3. Heavy-path decomposition: each node's child with the largest subtree continues its chain. Any path to a root crosses
   ``log2(n)`` chains at most.
4. Chains form a tree of their own, of logarithmic depth. Sums along it give depth, root and the place of each chain
   in the preorder of its tree; paths are put together from one text a chain prefix, and the descendants of a node are an interval.

Each round is one join of written tables, so depth costs a logarithm of rounds and lineage stays short. No round
collects anything but row counts and the hashes of the most frequent keys, which are spread over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators.blocks import block_running_sum
from tilewright.operators.skew import frequent_hashes, salted_join
from tilewright.runtime import Cut, Rounds

#: ids of a chain in one text
_BLOCK = 256


class Forest:
    """The decomposition of the parent relation of ``df`` (columns ``node`` and ``parent``, strings).

    One node per distinct non-null ``node``; rows with a null node are left out. Rows of one node must agree about the
    parent; where they do not, the smallest non-null one holds. A null parent or one that is no node makes a root.
    Repeated rows change nothing, an empty table gives an empty forest, a node that is its own parent is a cycle.
    Keys are spread where a join has ``spread_from`` rows or more; below that any key fits a task.
    """

    def __init__(self, df: DataFrame, node: str = "id", parent: str = "parent", spread_from: int = 1_000_000):
        self.spread_from = spread_from
        pairs = df.where(F.col(node).isNotNull()).select(F.col(node).alias("_id"), F.col(parent).alias("_parent"))
        nodes = Cut(pairs.groupBy("_id").agg(F.min("_parent").alias("_parent")).withColumn("_code", F.monotonically_increasing_id()), "nodes")
        self.n = nodes.count()
        self.names = nodes.df.select("_code", "_id")
        up = self.names.select(F.col("_code").alias("_up"), F.col("_id").alias("_parent"))
        links = self._join(nodes.df.select("_code", "_parent"), up, "_parent", self.n, "left")
        self.links = Cut(links.select("_code", "_up"), "links")
        self._double(self._rake())
        #: parents with so many children that they are spread
        self._wide = frequent_hashes(self.tree.where("_up is not null"), ["_up"]) if self.n >= spread_from else []
        self._chains()

    def _join(self, many: DataFrame, one: DataFrame, key: str, rows: int, how: str = "inner") -> DataFrame:
        return salted_join(many, one, [key], how) if rows >= self.spread_from else many.join(one, key, how)

    def _rake(self) -> DataFrame:
        """Cuts leaves off; what is left as (_code, _up, _w), where ``_w`` counts the node and what was cut off below it."""
        alive, left = self.links.df.withColumn("_w", F.lit(1).cast("long")), self.n
        self.raked = Rounds(alive.sparkSession, "raked")
        while True:
            parents = alive.where("_up is not null").select(F.col("_up").alias("_code")).distinct().withColumn("_inner", F.lit(True))
            now = self.raked.write(alive.join(parents, "_code", "left").withColumn("_inner", F.coalesce("_inner", F.lit(False))))
            inner = now.where("_inner")
            cut = now.where("not _inner and _up is not null").groupBy(F.col("_up").alias("_code")).agg(F.sum("_w").alias("_add"))
            alive = inner.join(cut, "_code", "left").select("_code", "_up", (F.col("_w") + F.coalesce("_add", F.lit(0))).alias("_w"))
            kept = inner.count()
            if 2 * kept > left or not kept:
                return alive
            left = kept

    def _double(self, alive: DataFrame) -> None:
        core = Cut(alive, "core")
        jumps = Rounds(alive.sparkSession, "jump")
        u = jumps.write(core.df.where("_up is not null").select("_code", F.col("_up").alias("_to"), F.col("_w").alias("_s")))
        left, targets = u.count(), -1
        while left:
            below = u.groupBy(F.col("_to").alias("_code")).agg(F.sum("_s").alias("_add"))
            over = u.select(F.col("_code").alias("_to"), F.col("_to").alias("_far"))
            far = self._join(u, over, "_to", left).join(below, "_code", "left")
            u = jumps.write(far.select("_code", F.col("_far").alias("_to"), (F.col("_s") + F.coalesce("_add", F.lit(0))).alias("_s")))
            now = u.count()
            if now == left:  # whoever is left has ancestors without end; has their image settled on the cycles?
                seen = u.agg(F.count_distinct("_to")).first()[0]
                if seen == targets:
                    break
                targets = seen
            left = now
        loops = u.select(F.col("_to").alias("_code")).distinct().withColumn("_loop", F.lit(True))
        grown = jumps.all().groupBy(F.col("_to").alias("_code")).agg(F.sum("_s").alias("_add"))
        deep = core.df.join(grown, "_code", "left").join(loops, "_code", "left")
        loop = F.coalesce("_loop", F.lit(False))
        deep = deep.select("_code", F.when(~loop, F.col("_up")).alias("_up"), (F.col("_w") + F.coalesce("_add", F.lit(0))).alias("_size"), loop.alias("_loop"))
        flat = self.raked.all().where("not _inner").select("_code", "_up", F.col("_w").alias("_size"), F.lit(False).alias("_loop"))
        self.tree = Cut(flat.unionByName(deep), "tree").df
        for table in (jumps, core, self.raked, self.links):
            table.drop()

    def _resolve(self, pending: DataFrame, final: DataFrame, sums: list[str], chains: bool) -> DataFrame:
        """Rows (_code, _to, sums...) with every pointer followed to its end and ``sums`` added up on the way.

        ``final`` rows point to an end already, ``pending`` ones to another row. Each round all pending rows jump as far as
        the rows they point to, so the rounds are a logarithm of the longest way; only pending rows are written again.
        ``chains``: no two pending rows point to the same row.
        """
        rounds = Rounds(pending.sparkSession, "resolved")
        now = rounds.write(pending.withColumn("_end", F.lit(False)).unionByName(final.withColumn("_end", F.lit(True))))
        while left := now.where("not _end").count():
            open_ = now.where("not _end").drop("_end")
            known = rounds.all().where(f"_end or _round = {rounds.count - 1}")
            known = known.select(F.col("_code").alias("_to"), F.col("_to").alias("_far"), *[F.col(c).alias(f"_m{c}") for c in sums], "_end")
            far = open_.join(known, "_to") if chains else self._join(open_, known, "_to", left)
            now = rounds.write(far.select("_code", F.col("_far").alias("_to"), *[(F.col(c) + F.col(f"_m{c}")).alias(c) for c in sums], "_end"))
        return rounds.all().where("_end").drop("_end", "_round")

    def _chains(self) -> None:
        children = self.tree.where("_up is not null")
        heavy = children.groupBy("_up").agg(F.max(F.struct("_size", (-F.col("_code")).alias("c"))).alias("_h")).select(
            "_up", (-F.col("_h.c")).alias("_heavy"), F.col("_h._size").alias("_heavy_size")
        )
        heavy = Cut(heavy, "heavy").df
        first = self.tree.join(heavy.select(F.col("_heavy").alias("_code")), "_code", "left_anti").select(
            "_code", F.col("_code").alias("_to"), F.lit(0).cast("long").alias("_off")
        )
        inner = heavy.select(F.col("_heavy").alias("_code"), F.col("_up").alias("_to"), F.lit(1).cast("long").alias("_off"))
        #: every node with its chain (named by its head) and its place in it
        self.chain = self._resolve(inner, first, ["_off"], True).withColumnRenamed("_to", "_head")
        # light children: where their chain hangs, and how far into the parent's subtree it starts
        light = salted_join(children.drop("_loop"), heavy, ["_up"], hot=self._wide).where("_code != _heavy")
        light = block_running_sum(light, ["_up"], "_code", "_size", "_sum", bits=14)
        light = light.select(F.col("_code").alias("_head"), "_up", (F.lit(1) + F.col("_heavy_size") + F.col("_sum") - F.col("_size")).alias("_rel"))
        at = self.chain.select(F.col("_code").alias("_up"), F.col("_head").alias("_to"), F.col("_off").alias("_at"))
        sums = ["_depth", "_pre", "_hops"]
        hung = salted_join(light, at, ["_up"], hot=self._wide).select(
            F.col("_head").alias("_code"), "_to", (F.col("_at") + 1).alias("_depth"), (F.col("_at") + F.col("_rel")).alias("_pre"), F.lit(1).cast("long").alias("_hops")
        )
        hung = Cut(hung, "hang").df
        #: every chain that hangs on another one, and the place there
        self.hung = hung.select(F.col("_code").alias("_head"), F.col("_to").alias("_on"), (F.col("_depth") - 1).alias("_cut"))
        tops = self.tree.where("_up is null").select("_code", F.col("_code").alias("_to"), *[F.lit(0).cast("long").alias(c) for c in sums])
        #: every chain with its root, the depth and preorder place of its head, and the number of chains above it
        self.heads = self._resolve(hung, tops, sums, False).withColumnRenamed("_code", "_head")
        self.roots = self.tree.where("_up is null").select(F.col("_code").alias("_root"), "_loop")

    def nodes(self) -> DataFrame:
        """(id, root_id, depth, descendants, first, last): the descendants of a node are the nodes of the same root whose
        ``first`` lies in (first, last]. Nodes on a cycle have root_id '' and depth -1, nodes below one '' and -2, and nulls."""
        heads = self.heads.select("_head", F.col("_to").alias("_root"), F.col("_depth").alias("_d"), F.col("_pre").alias("_p"))
        roots = self.roots.join(self.names.select(F.col("_code").alias("_root"), F.col("_id").alias("_name")), "_root")
        heads = self._join(heads, roots, "_root", self.n)
        placed = self._join(self.chain, heads, "_head", self.n).join(self.tree.select("_code", "_size"), "_code").join(self.names, "_code")
        depth = F.when(~F.col("_loop"), F.col("_off") + F.col("_d")).when(F.col("_code") == F.col("_root"), -1).otherwise(-2)
        inside = lambda c: F.when(~F.col("_loop"), c)
        first = F.col("_off") + F.col("_p")
        return placed.select(
            F.col("_id").alias("id"), F.when(F.col("_loop"), "").otherwise(F.col("_name")).alias("root_id"), depth.cast("int").alias("depth"),
            inside(F.col("_size") - 1).alias("descendants"), inside(first).alias("first"), inside(first + F.col("_size") - 1).alias("last"),
        )

    def _rooted(self) -> DataFrame:
        """The chains whose root is on no cycle: _head, _depth, _hops."""
        good = self.roots.where("not _loop").select(F.col("_root").alias("_to"))
        return self._join(self.heads, good, "_to", self.n, "left_semi").select("_head", "_depth", "_hops")

    def segments(self) -> DataFrame:
        """(_code, _seq, _head, _upto): the pieces of each node's path from the root down, chain ``_head`` from place 0 to ``_upto``.

        There are ``log2(n) + 1`` pieces per node at most, so this is the compact form of all paths. Nodes on or below a cycle have none.
        """
        heads = Cut(self._rooted(), "rooted").df
        above = self.hung.select(F.col("_head").alias("_on"), F.col("_on").alias("_next"), F.col("_cut").alias("_c"))
        parts = Rounds(heads.sparkSession, "pieces")
        cur = parts.write(heads.select("_head", F.col("_head").alias("_on"), F.lit(None).cast("long").alias("_cut"), F.col("_hops").alias("_seq")))
        while left := cur.where("_seq > 0").count():
            nxt = self._join(cur.where("_seq > 0").select("_head", "_on", "_seq"), above, "_on", left)
            cur = parts.write(nxt.select("_head", F.col("_next").alias("_on"), F.col("_c").alias("_cut"), (F.col("_seq") - 1).alias("_seq")))
        return self._join(self.chain, parts.all(), "_head", self.n).select("_code", "_seq", F.col("_on").alias("_head"), F.coalesce("_cut", "_off").alias("_upto"))

    def ancestry(self) -> DataFrame:
        """(id, ancestor, depth): every tree node with each node of its path, itself included; ``depth`` is the ancestor's.

        Read as (ancestor, id) these are all descendants. It has as many rows as all paths have nodes; the intervals of ``nodes``
        say the same in a row a node.
        """
        depth = self.heads.select("_head", F.col("_depth").alias("_d"))
        members = self._join(self.chain.select("_head", F.col("_off").alias("_o"), F.col("_code").alias("_anc")), depth, "_head", self.n)
        steps = self.segments().select("_code", "_head", F.explode(F.sequence(F.lit(0).cast("long"), "_upto")).alias("_o"))
        spread = salted_join if self.n >= self.spread_from else DataFrame.join
        pairs = spread(steps, members, ["_head", "_o"]).select("_code", "_anc", (F.col("_o") + F.col("_d")).cast("int").alias("depth"))
        anc = self.names.select(F.col("_code").alias("_anc"), F.col("_id").alias("ancestor"))
        named = self._join(pairs, anc, "_anc", self.n)
        return self._join(named, self.names, "_code", self.n).select(F.col("_id").alias("id"), "ancestor", "depth")

    def paths(self, separator: str = "/", block: int = _BLOCK) -> DataFrame:
        """(id, path): the ids from the root down, joined by ``separator``; a row is as long as its path.

        A chain is cut into blocks of ``block`` ids. The text above a block is that above its chain and the texts of the blocks before
        it; the text above a chain is the path of the node it hangs on, taken from that node's block. So a level of chains is one round,
        and a node costs its own text and nothing for each of its ancestors.
        """
        at = F.floor(F.col("_off") / block)
        named = self.chain.join(self.names, "_code").select("_head", at.alias("_b"), F.struct("_off", F.col("_id").alias("id")).alias("_m"))
        listed = named.groupBy("_head", "_b").agg(F.array_sort(F.collect_list("_m")).alias("_m"))  # as many as a block has
        blocks = Cut(listed.select("_head", "_b", F.transform("_m", lambda m: m["id"]).alias("_ids")), "blocks").df
        heads = Cut(self._rooted(), "rooted").df
        levels = (heads.agg(F.max("_hops")).first()[0] or 0) + 1
        out = Rounds(heads.sparkSession, "above")
        above = heads.where("_hops = 0").select("_head", F.lit(None).cast("string").alias("_text"))
        for k in range(levels):
            own = blocks.join(above, "_head")  # a chain has few blocks
            earlier = blocks.where("_ids is not null").select("_head", F.col("_b").alias("_e"), F.array_join("_ids", separator).alias("_t"))
            long = own.where("_b > 0").select("_head", "_b").join(earlier, "_head").where("_e < _b")
            before = long.groupBy("_head", "_b").agg(F.array_sort(F.collect_list(F.struct("_e", "_t"))).alias("_l"))
            before = before.select("_head", "_b", F.array_join(F.transform("_l", lambda x: x["_t"]), separator).alias("_before"))
            full = own.join(before, ["_head", "_b"], "left")
            now = out.write(full.select("_head", "_b", "_ids", F.when(F.col("_text").isNotNull() | F.col("_before").isNotNull(), F.concat_ws(separator, "_text", "_before")).alias("_text")))
            if k + 1 < levels:
                hang = self.hung.join(heads.where(f"_hops = {k + 1}").select("_head"), "_head").select("_head", F.col("_on"), F.floor(F.col("_cut") / block).alias("_b"), (F.col("_cut") % block + 1).cast("int").alias("_upto"))
                held = now.select(F.col("_head").alias("_on"), "_b", F.col("_ids").alias("_i"), F.col("_text").alias("_t"))
                spread = salted_join if self.n >= self.spread_from else DataFrame.join
                above = spread(hang, held, ["_on", "_b"]).select("_head", F.concat_ws(separator, "_t", F.array_join(F.slice("_i", F.lit(1), F.col("_upto")), separator)).alias("_text"))
        each = out.all().select("_text", "_ids", F.posexplode("_ids").alias("_i", "id"))
        return each.select("id", F.concat_ws(separator, "_text", F.array_join(F.slice("_ids", F.lit(1), F.col("_i") + 1), separator)).alias("path"))

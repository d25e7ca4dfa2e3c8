"""Accounts linked through shared devices and payments."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import heavy_salts, salted_join
from ..functions.text import is_blank
from ..session import discard, materialize


def device_edges(txn: DataFrame) -> DataFrame:
    """Distinct account-device pairs."""
    seen = txn.filter(~is_blank(F.col("device_id")))
    return seen.select("account_no", "device_id").distinct()


def _turn(round_number: int) -> int:
    """Bits that turn the order of the node ids; any fixed sequence of mixed bits does."""
    return int.from_bytes(hashlib.sha256(str(round_number).encode()).digest()[:8], "big", signed=True)


@dataclass
class Contraction:
    """Where a contraction ended: a stored table ``u``, ``p`` of nodes and their roots, and the number of edges before each round."""

    stored: DataFrame
    edges: list[int]

    @property
    def roots(self) -> DataFrame:
        return self.stored.select(F.col("u").alias("node"), F.col("p").alias("root"))


def contract(edges: DataFrame, max_rounds: int = 200) -> Contraction:
    """Contract the components of an undirected graph, given as edges ``u``, ``v`` of 64-bit node ids, to one node each.

    In each round every node goes into the smallest of itself and its neighbours. Edges are renamed to these nodes,
    and what became equal or a loop is dropped, so edges shrink from round to round; the order of the ids is
    turned each time, so long chains lose a fixed share of their nodes per round, and rounds grow with the
    logarithm of the longest chain. The renamings are then composed backwards. Minima are taken before
    the shuffle; nodes with very many edges are spread when the edges are renamed. Nodes without edges do not appear.
    """
    spark = edges.sparkSession
    current = materialize(_tidy(edges), "edges-0")
    counts, moves = [current.count()], []
    while counts[-1]:
        if len(moves) == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        turn = F.lit(_turn(len(moves)))
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = both.groupBy("u").agg(F.min(F.col("v").bitwiseXOR(turn)).alias("m"), F.count(F.lit(1)).alias("_rows"))
        into = F.least(F.col("m"), F.col("u").bitwiseXOR(turn)).bitwiseXOR(turn)
        move = materialize(nearest.select("u", into.alias("p"), "_rows"), f"moves-{len(moves)}")
        heavy, to = heavy_salts(move.select("u", "_rows"), ["u"]), move.select("u", "p")
        renamed = salted_join(current, to, ["u"], ["v"], heavy=heavy, rows=counts[-1]).select("v", F.col("p").alias("a"))
        other, heavy = to.select(F.col("u").alias("v"), F.col("p").alias("b")), heavy.withColumnRenamed("u", "v")
        renamed = salted_join(renamed, other, ["v"], ["a"], heavy=heavy, rows=counts[-1]).select(F.col("a").alias("u"), F.col("b").alias("v"))
        following = materialize(_tidy(renamed), f"edges-{len(moves) + 1}")
        discard(current)
        moves.append(move)
        current = following
        counts.append(current.count())
    if not moves:
        return Contraction(current.select("u", F.col("v").alias("p")), counts)
    final = moves.pop()
    for k, move in enumerate(reversed(moves)):
        further = final.select(F.col("u").alias("p"), F.col("p").alias("q"))
        composed = salted_join(move.select("u", "p"), further, ["p"], ["u"], "left", rows=counts[len(moves) - k - 1] * 2).select("u", F.coalesce("q", "p").alias("p"))
        composed = materialize(composed, f"roots-{k}")
        discard(final)
        discard(move)
        final = composed
    discard(current)
    return Contraction(final, counts)


def _tidy(edges: DataFrame) -> DataFrame:
    """Each edge once, the smaller end first, no loops."""
    return edges.filter(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def shared_device_groups(txn: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Connected groups of accounts that share devices, named by their smallest account."""
    pairs = materialize(device_edges(txn), "device-edges")
    sides = {"account_no": 0, "device_id": 1}

    def named(column: str) -> DataFrame:
        # a count makes ids unique, and a one-to-one hash of it puts them in no particular order
        nodes = pairs.select(column).distinct()
        number = F.monotonically_increasing_id() * 2 + sides[column]
        return materialize(nodes.select(column, F.xxhash64(number).alias(f"{column}_node")), f"nodes-{column}")

    accounts, devices, rows = named("account_no"), named("device_id"), pairs.count()
    edges = salted_join(pairs, accounts, ["account_no"], ["device_id"], rows=rows)
    edges = salted_join(edges, devices, ["device_id"], ["account_no"], rows=rows)
    found = contract(edges.select(F.col("account_no_node").alias("u"), F.col("device_id_node").alias("v")), max_rounds)
    # every account has a device, so every account has a root
    rooted = accounts.join(found.roots, F.col("account_no_node") == F.col("node")).select("account_no", "root")
    least = rooted.groupBy("root").agg(F.min("account_no").alias("group_id"))
    groups = salted_join(rooted, least, ["root"], ["account_no"], rows=rows).select("account_no", "group_id")
    out = materialize(groups, "account-groups")
    for used in (pairs, accounts, devices, found.stored):
        discard(used)
    return out


def gang_risk(groups: DataFrame, txn: DataFrame, labels: DataFrame, density: float = 0.05, min_accounts: int = 2) -> DataFrame:
    """Per group: accounts, labelled transactions, frauds, and a flag where frauds are dense."""
    fraud = F.when(F.col("label") == "FRAUD", 1).otherwise(0)
    per_account = (
        txn.select("source_id", "txn_id", "account_no")
        .join(labels.select("source_id", "txn_id", "label"), ["source_id", "txn_id"])
        .groupBy("account_no")
        .agg(F.count(F.lit(1)).alias("labelled"), F.sum(fraud).alias("frauds"))
    )
    stats = (
        groups.join(per_account, "account_no", "left")
        .groupBy("group_id")
        .agg(
            F.count(F.lit(1)).alias("accounts"),
            F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled"),
            F.coalesce(F.sum("frauds"), F.lit(0)).alias("frauds"),
        )
    )
    dense = (F.col("accounts") >= min_accounts) & (F.col("labelled") > 0) & (F.col("frauds") >= density * F.col("labelled"))
    return stats.withColumn("gang_risk_flag", dense)


def payment_edges(txn: DataFrame) -> DataFrame:
    """Distinct payer-payee pairs."""
    return txn.filter(F.col("counterparty").isNotNull()).select("account_no", "counterparty").distinct()


def fund_role(txn: DataFrame, hub: int = 50, relay: int = 20) -> DataFrame:
    """Role by number of distinct payers and payees: relay where both are many, hub where one is."""
    edges = payment_edges(txn)
    ends = edges.select(F.col("account_no").alias("account"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(F.col("counterparty").alias("account"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    degrees = ends.groupBy("account").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    i, o = F.col("in_degree"), F.col("out_degree")
    role = F.when((i >= relay) & (o >= relay), "RELAY").when(i >= hub, "COLLECTOR").when(o >= hub, "DISTRIBUTOR").otherwise("ORDINARY")
    return degrees.withColumn("fund_role", role)


def linked_within(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """Accounts one or more shared devices away from a seed account, with the number of hops.

    ``edges`` are account-device pairs, ``seeds`` one column of accounts. Each hop asks which devices
    the reached accounts use and who else uses those, as semi-joins over distinct nodes; pairs of
    accounts are never formed, so a device shared by very many costs one row per account.
    """
    reached = seeds.toDF("account_no").distinct().withColumn("hops", F.lit(0))
    for hop in range(1, hops + 1):
        frontier = reached.filter(F.col("hops") == hop - 1).select("account_no")
        devices = edges.join(frontier, "account_no", "left_semi").select("device_id").distinct()
        near = salted_join(edges, devices, ["device_id"], ["account_no"], "left_semi").select("account_no").distinct()
        fresh = near.join(reached.select("account_no"), "account_no", "left_anti").withColumn("hops", F.lit(hop))
        reached = reached.unionByName(fresh)
    return reached.filter(F.col("hops") > 0)

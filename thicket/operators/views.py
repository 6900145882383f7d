"""Dataset views: filtering, oversampling, order, padding, masks and batches of encoded samples.

Positions are rows or arrays of one sample; batches are a column. Random choices are hashes of a seed and a key, so
reruns agree and a lost task computes the same again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.text import pad_or_truncate
from thicket.schema import CLS, MAX_TOKENS, NUM_SUB_TOKENS, PAD, SEP
from thicket.session import written


def hashed(seed: int, *keys: str) -> Column:
    """A text that depends on the seed and the keys alone, in an order that is as good as random: any engine gives the same."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def uniform(seed: int, *keys: str) -> Column:
    """A number in [0, 1) that depends on the seed and the keys alone: the first 52 bits of their hash."""
    return F.conv(F.substring(hashed(seed, *keys), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def within_limit(rows: DataFrame, tokens: str = "tokens", limit: int = MAX_TOKENS) -> DataFrame:
    """Samples of at most `limit` tokens without a lexer error; failed samples (null) go."""
    t = F.col(tokens)
    return rows.where(t.isNotNull() & (F.size(t) <= limit) & ~F.exists(t, lambda x: x["token_type"] == "Token.Error"))


def oversampled(rows: DataFrame, factors: DataFrame, key: str, seed: int, *ids: str) -> DataFrame:
    """Each row as often as its key's factor says; the fraction is a seeded coin. Factors: key, factor; one row a key."""
    times = F.floor("factor") + (uniform(seed, *ids) < F.col("factor") - F.floor("factor")).cast("int")
    copies = F.when(times > 0, F.sequence(F.lit(1), times.cast("int"))).otherwise(F.array().cast("array<int>"))
    out = rows.join(factors, key).withColumn("copy", F.explode(copies))
    return out.drop("factor")


def shuffled(rows: DataFrame, seed: int, *ids: str) -> DataFrame:
    """A full shuffle in an order that the seed fixes: a range sort by hash."""
    return rows.orderBy(hashed(seed, *ids), *ids)


def preceding(rows: DataFrame, part: str, amount: Column, *order: str, slots: int | None = None) -> DataFrame:
    """rows with _before: the sum of an amount over the part's rows that come before in the order. A part isn't one task: it is cut into
    ranges of its first order column, a number, at percentiles; each range is summed on its own, and ranges before it are added. The cuts
    only divide the work, so the sums don't depend on them. There are as many ranges as the session's shuffles have partitions, 64 at least,
    so they grow with the data as those do; the first order column has to tell rows apart (see `spread`)."""
    slots = slots or max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.groupBy(part).agg(F.percentile_approx(order[0], F.array(*(F.lit(k / slots) for k in range(1, slots))), F.lit(1000)).alias("_cuts"))
    slot = F.size(F.filter(F.coalesce("_cuts", F.array()), lambda c: c < F.col(order[0])))
    out = rows.join(cuts.withColumnRenamed(part, "_part"), F.col(part).eqNullSafe(F.col("_part")), "left").withColumn("_slot", slot).withColumn("_amount", amount)
    sums = out.groupBy(F.col(part).alias("_p"), F.col("_slot").alias("_s")).agg(F.sum("_amount").alias("_sum"))
    base = F.coalesce(F.sum("_sum").over(Window.partitionBy("_p").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("_p", "_s", base.alias("_base"))
    own = F.coalesce(F.sum("_amount").over(Window.partitionBy(part, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = out.withColumn("_own", own).join(sums, F.col(part).eqNullSafe(F.col("_p")) & (F.col("_slot") == F.col("_s")))
    return out.withColumn("_before", F.col("_own") + F.col("_base")).drop("_part", "_cuts", "_slot", "_amount", "_own", "_p", "_s", "_base")


def spread(number: str, seed: int, *ids: str) -> Column:
    """A whole number with a seeded fraction, so that equal ones can be cut apart by ranges."""
    return F.col(number) + uniform(seed, *ids)


def chunk_shuffled(rows: DataFrame, part: str, length: str, k: int, seed: int, *ids: str) -> DataFrame:
    """Within each part: sorted by length (equal ones by hash), cut into chunks of k, chunks in a seeded order. Gives chunk and place."""
    out = preceding(rows.withColumn("_order", spread(length, seed, *ids)), part, F.lit(1), "_order", *ids)
    out = out.withColumn("chunk", F.floor(F.col("_before") / k).cast("int")).withColumnRenamed("_before", "_rn")
    out = preceding(out.withColumn("_order", uniform(seed, "chunk")), part, F.lit(1), "_order", "chunk", "_rn")
    return out.withColumn("place", F.col("_before").cast("int")).drop("_rn", "_order", "_before")


def batches(rows: DataFrame, part: str, size: int, *order: str) -> DataFrame:
    """batch: consecutive runs of `size` rows within each part."""
    return preceding(rows, part, F.lit(1), *order).withColumn("batch", F.floor(F.col("_before") / size).cast("int")).drop("_before")


def accumulated(rows: DataFrame, part: str, amount: str, target: int, *order: str) -> DataFrame:
    """window: runs of rows whose amounts add up to about `target`."""
    return preceding(rows, part, F.col(amount), *order).withColumn("window", F.floor(F.col("_before") / target).cast("int")).drop("_before")


def padded_to_batch(rows: DataFrame, batch: str, tokens: str, pad: Column) -> DataFrame:
    """tokens padded to the longest of the batch; pad_mask: 1 where padding is."""
    longest = F.max(F.size(tokens)).over(Window.partitionBy(batch))
    out = rows.withColumn("_n", longest).withColumn("_size", F.size(tokens))
    mask = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: (i >= F.col("_size")).cast("int"))
    return out.withColumn("pad_mask", mask).withColumn(tokens, F.slice(F.concat(tokens, F.array_repeat(pad, F.col("_n"))), F.lit(1), F.col("_n"))).drop("_n", "_size")


def long_enough(rows: DataFrame, words: str, least: int, labels: str | None = None, least_labels: int = 0) -> DataFrame:
    """Samples of at least `least` tokens and `least_labels` parts of the label."""
    ok = F.size(words) >= least
    return rows.where(ok if labels is None else ok & (F.size(labels) >= least_labels))


def small_trees(rows: DataFrame, nodes: DataFrame, most: int, sample: str = "sample_id") -> DataFrame:
    """Samples whose tree has at most `most` nodes."""
    return rows.join(nodes.groupBy(sample).agg(F.count("*").alias("_n")).where(F.col("_n") <= most), sample, "left_semi")


def attention_view(samples: DataFrame, n_cls: int = 5, sample: str = "sample_id") -> DataFrame:
    """(sample, i, kind) of a sample of n words with its label masked at `at`: positions that may not be attended (`blocked`: the padding
    of the batch, from n to width), and those that are targets (`target`: the class tokens and the mask). samples: sample, n, width, at."""
    blocked = F.when(F.col("width") > F.col("n"), F.sequence(F.col("n"), F.col("width") - 1)).otherwise(F.array().cast("array<int>"))
    target = F.array_union(F.sequence(F.lit(0), F.lit(n_cls - 1)), F.array("at"))
    kinds = F.array(F.struct(F.lit("blocked").alias("kind"), blocked.alias("x")), F.struct(F.lit("target").alias("kind"), target.alias("x")))
    return samples.select(sample, F.explode(kinds).alias("k")).select(sample, "k.kind", F.explode("k.x").alias("i"))


def reservoir(rows: DataFrame, sample: str, most: int, seed: int, *ids: str) -> DataFrame:
    """At most `most` rows of each sample, chosen by hash, each with the same probability. Spark takes each task's best before it shuffles."""
    w = Window.partitionBy(sample).orderBy(hashed(seed, sample, *ids), *ids)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def pad_mask(length: Column, width: Column | int) -> Column:
    """1 for the positions of a sample, 0 for the padding up to the width of its batch."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.concat(F.array_repeat(F.lit(1), F.least(length, width)), F.array_repeat(F.lit(0), F.greatest(width - length, F.lit(0))))


def sub_token_ids(ids: Column, n: int = NUM_SUB_TOKENS) -> Column:
    """Ids of a token's parts padded to n."""
    return pad_or_truncate(ids, n, F.lit(PAD))


def with_offsets(tokens: DataFrame, sample: str, pos: str, n: str) -> DataFrame:
    """offset: the flat position of a token's first part."""
    w = Window.partitionBy(sample).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("offset", F.coalesce(F.sum(n).over(w), F.lit(0)))


def keeps_text(word: Column) -> Column:
    """Tokens with a letter, an underscore or the unknown symbol stay in views without punctuation."""
    return word.rlike("[A-Za-z]") | F.contains(word, F.lit("_")) | (word == "<unk>")


def without_punctuation(tokens: DataFrame, sample: str = "sample_id", pos: str = "pos", word: str = "word") -> DataFrame:
    """Kept tokens, numbered anew in their order."""
    kept = tokens.where(keeps_text(F.col(word)))
    return kept.withColumn("new_pos", (F.row_number().over(Window.partitionBy(sample).orderBy(pos)) - 1).cast("int"))


def label_position(words: Column, label: Column, unknown: str = "<unk>") -> Column:
    """First place (from 0) at which the label's parts follow one another; unknown parts of the label meet unknown words.
    Null where it doesn't occur."""
    n, k = F.size(words), F.size(label)
    starts = F.when((k > 0) & (n >= k), F.sequence(F.lit(1), n - k + 1)).otherwise(F.array().cast("array<int>"))
    fits = lambda i: F.forall(F.zip_with(F.slice(words, i, k), label, lambda a, b: a == b), lambda x: x)
    return F.try_element_at(F.filter(starts, fits), F.lit(1)) - 1


def masked_label(words: Column, at: Column, k: Column, mask: str = "[CLS_10]") -> Column:
    """words with the label's k parts replaced by one mask."""
    return F.concat(F.slice(words, F.lit(1), at), F.array(F.lit(mask)), F.slice(words, at + k + 1, F.size(words)))


def with_cls(words: Column, n: int = 5) -> Column:
    """The class tokens before a sample."""
    return F.concat(F.array(*(F.lit(f"[CLS_{i}]") for i in range(1, n + 1))), words)


def sampled_positions(rows: DataFrame, sample: str, k: int, seed: int) -> DataFrame:
    """k positions of each sample without replacement, by hash; padding positions (n and above) can't be drawn."""
    at = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    w = Window.partitionBy(sample).orderBy(hashed(seed, sample, "pos"), "pos")
    return rows.select(sample, "n", at.alias("pos")).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def permutation(rows: DataFrame, sample: str, pos: str, seed: int) -> DataFrame:
    """perm: the place of each position in a seeded permutation of its sample."""
    w = Window.partitionBy(sample).orderBy(hashed(seed, sample, pos), pos)
    return rows.withColumn("perm", (F.row_number().over(w) - 1).cast("int"))


def permutation_mask(samples: DataFrame, tokens: str = "tokens") -> DataFrame:
    """samples with `blocked`, an array of arrays: 1 where position i may not attend position j. tokens: an array of (token, is_target, perm).

    Ordinary words that aren't targets are seen by all; targets and functional tokens only by later ones of the
    permutation, and targets don't see themselves. A sample's mask is made from its own row, so nothing is joined or shuffled.
    """
    hidden = lambda t: t["is_target"] | t["token"].isin(SEP, CLS)
    rev = lambda t: F.when(hidden(t), t["perm"]).otherwise(F.lit(-1))
    # what a position must lie behind to be blocked, and where others see it: above every number if they always do
    marks = F.transform(tokens, lambda t: F.struct(F.when(t["is_target"], rev(t)).otherwise(rev(t) + 1).alias("own"), F.when(hidden(t), rev(t)).otherwise(F.lit(-2)).alias("seen")))
    rows = samples.withColumn("_marks", marks)
    return rows.withColumn("blocked", F.transform("_marks", lambda a: F.transform(F.col("_marks.seen"), lambda s: (a["own"] <= s).cast("int")))).drop("_marks")


def language_model_view(tokens: DataFrame, k: int, seed: int, sample: str = "sample_id") -> DataFrame:
    """tokens (sample, pos, token) with is_target, perm and label: k targets of each sample, by hash. A window for each choice, both within a sample: where samples are
    dealt out already, nothing is shuffled."""
    w = Window.partitionBy(sample).orderBy(hashed(seed, sample, "pos"), "pos")
    out = tokens.withColumn("is_target", F.row_number().over(w) <= k)
    return permutation(out, sample, "pos", seed + 1).withColumn("label", F.when(F.col("is_target"), F.col("token")))


def pointer_view(tokens: DataFrame, pad: int = PAD, sample: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """Pointers of a language model's samples: a model may not copy what it has to predict. tokens: (sample, pos, is_target, ids), ids being the ids of a token's
    parts in the extended vocabulary, padding among them.

    Gives the ids that can be pointed at (sample, ids: those of tokens that aren't targets, in order, without padding), and the mask of the
    parts (sample, pos, mask: as long as ids, true where one is left). Samples without any id left have an empty array.
    """
    mask = F.transform("ids", lambda x: (x != pad) & ~F.col("is_target"))
    rows = tokens.withColumn("mask", mask).withColumn("_left", F.filter("ids", lambda x: (x != pad) & ~F.col("is_target")))
    lists = rows.groupBy(sample).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_left"))), lambda x: x["_left"])).alias("ids"))
    return lists, rows.select(sample, "pos", "mask")


def split_by_hash(rows: DataFrame, share: float, seed: int, *ids: str) -> DataFrame:
    """partition: train for `share` of the rows, else valid; by a hash of the ids."""
    return rows.withColumn("partition", F.when(uniform(seed, *ids) < share, "train").otherwise("valid"))


def best_so_far(scores: DataFrame, run: str, step: str, score: str, patience: int) -> DataFrame:
    """Early stopping: the best score so far, steps since it was reached, and whether training stops there; with the
    rank among all snapshots of the run."""
    w = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    out = scores.withColumn("best", F.max(score).over(w))
    rows = out.withColumn("_rn", F.row_number().over(Window.partitionBy(run).orderBy(step)))
    at = F.max(F.when((F.col(score) == F.col("best")) & (F.coalesce(F.lag("best").over(Window.partitionBy(run).orderBy(step)), F.col("best") - 1) < F.col("best")), F.col("_rn"))).over(w)
    rows = rows.withColumn("waited", F.col("_rn") - at)
    rank = F.rank().over(Window.partitionBy(run).orderBy(F.col(score).desc()))
    return rows.withColumn("stop", F.col("waited") >= patience).withColumn("snapshot_rank", rank).drop("_rn")



def summarisation_view(samples: DataFrame, words: DataFrame, size: int, n_cls: int = 5, n_label: int = 6) -> DataFrame:
    """Samples (sample_id, words, label) for predicting a name from its body: (sample_id, tokens, label_ids, at, pointers).

    Class tokens come first; the label's first occurrence is replaced by one mask, samples without one are left out;
    words and label parts are encoded, unknown ones as pointers size + rank of first occurrence in the sample.
    """
    from thicket.operators.vocab import encode, extended_ids

    s = samples.withColumn("at", label_position(F.col("words"), F.col("label"))).where("at is not null")
    s = s.withColumn("masked", with_cls(masked_label(F.col("words"), F.col("at"), F.size("label")), n_cls)).withColumn("at", F.col("at") + n_cls)
    words = written(words.select("word", "id"), "view-vocabulary")
    flat = written(encode(s.select("sample_id", F.posexplode("masked").alias("pos", "word")), words).select("sample_id", "pos", "word", "id"), "view-words")
    ext = extended_ids(flat, size)
    resolved = lambda df: df.join(ext, ["sample_id", "word"], "left").withColumn("id", F.when(F.col("id") > 0, F.col("id")).otherwise(F.coalesce("ext_id", F.lit(0))))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"])
    tokens = resolved(flat).groupBy("sample_id").agg(in_order.alias("tokens"))
    labels = resolved(encode(s.select("sample_id", F.posexplode("label").alias("pos", "word")), words)).groupBy("sample_id").agg(in_order.alias("label_ids"))
    pointers = ext.groupBy("sample_id").agg(F.count("*").alias("pointers"))
    out = s.select("sample_id", "at").join(tokens, "sample_id").join(labels, "sample_id").join(pointers, "sample_id", "left")
    return out.select("sample_id", "tokens", pad_or_truncate(F.col("label_ids"), n_label, F.lit(PAD)).alias("label_ids"), "at", F.coalesce("pointers", F.lit(0)).alias("pointers"))

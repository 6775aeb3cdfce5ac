"""Document categories: a hashed linear model with balanced weights, replay and self-training."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import HashingTF, NGram, Normalizer, StopWordsRemover, StringIndexer, Tokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.config import SELF_TRAIN_CONFIDENCE
from loomgraph.operators.relational import class_weights

#: Two lines for each category; the cold start until there are labels.
SEED = (
    ("A compiler turns functions, loops and types of a program into machine code", "Programming"),
    ("A neural network learns weights from examples by gradient descent", "Artificial Intelligence"),
    ("The lecture notes and homework of this semester are due before the exam", "College"),
    ("The paper states a hypothesis, a method, an experiment and its citations", "Research"),
    ("The budget lists interest, stocks, bonds, taxes and savings", "Finance"),
    ("My diary, birthday plans, recipes and travel with family and friends", "Personal"),
    ("The server handles requests of the API with queues, workers and caches", "Backend Development"),
    ("The page lays out components with styles, buttons and browser events", "Frontend Development"),
    ("Routers forward packets between subnets over TCP and resolve names by DNS", "Networking"),
    ("A query joins tables by an index inside a transaction of the database", "Databases"),
    ("Refactoring a class hierarchy with unit tests, a debugger and version control", "Programming"),
    ("A language model attends to tokens and is fine-tuned on prompts and answers", "Artificial Intelligence"),
    ("The professor grades assignments and the faculty publishes the course schedule", "College"),
    ("We survey prior literature, report significance and discuss limits of the study", "Research"),
    ("Quarterly revenue, invoices, loans and a portfolio with dividends and risk", "Finance"),
    ("Weekend plans, a workout routine, a shopping list and notes to myself", "Personal"),
    ("Microservices share messages, authenticate by tokens and scale behind a load balancer", "Backend Development"),
    ("Responsive layout, accessible forms and state of the client in a single page", "Frontend Development"),
    ("A firewall filters ports while a switch and a VPN carry traffic between hosts", "Networking"),
    ("Normal forms, replicas, a query plan and isolation levels of a relational store", "Databases"),
)


def features(dimensions: int = 1 << 18) -> list:
    """Words without stop words and their pairs, hashed and scaled to unit length."""
    half = dimensions // 2
    return [
        Tokenizer(inputCol="text", outputCol="__words"),
        StopWordsRemover(inputCol="__words", outputCol="__kept"),
        NGram(n=2, inputCol="__kept", outputCol="__pairs"),
        HashingTF(numFeatures=half, inputCol="__kept", outputCol="__f1"),
        HashingTF(numFeatures=half, inputCol="__pairs", outputCol="__f2"),
        VectorAssembler(inputCols=["__f1", "__f2"], outputCol="__raw"),
        Normalizer(inputCol="__raw", outputCol="features"),
    ]


def seed_rows(spark: SparkSession) -> DataFrame:
    """The cold start as ``(text, label)`` rows."""
    return spark.createDataFrame(list(SEED), "text string, label string").coalesce(1)


def train(samples: DataFrame, replay: DataFrame | None = None, rounds: int = 20, dimensions: int = 1 << 18, learner=None) -> PipelineModel:
    """Fit on new and replayed ``(text, label)`` rows, classes weighted alike; ``save`` and ``load`` are the model's own.

    ``learner`` takes the place of logistic regression.
    """
    rows = samples.select("text", "label")
    if replay is not None:
        rows = rows.unionByName(replay.select("text", "label"))
    weighted = rows.join(F.broadcast(class_weights(rows)), "label")  # a row for each class
    index = StringIndexer(inputCol="label", outputCol="__y", stringOrderType="alphabetAsc", handleInvalid="keep")
    model = learner or LogisticRegression(featuresCol="features", labelCol="__y", weightCol="weight", maxIter=rounds, regParam=0.01)
    return Pipeline(stages=[index, *features(dimensions), model]).fit(weighted)


def classify(docs: DataFrame, model: PipelineModel | None, text: str = "text") -> DataFrame:
    """Add ``category`` and ``category_conf`` of whole texts; without a model all is ``Uncategorized`` with 0."""
    if model is None:
        return docs.withColumn("category", F.lit("Uncategorized")).withColumn("category_conf", F.lit(0.0))
    labels = F.array(*[F.lit(x) for x in model.stages[0].labels])
    rows = docs.withColumn("text", F.coalesce(F.col(text), F.lit(""))).withColumn("label", F.lit(model.stages[0].labels[0]))
    scored = model.transform(rows).withColumn("__p", F.slice(vector_to_array("probability"), 1, len(model.stages[0].labels)))
    best = F.array_max("__p")
    return scored.select(*docs.columns, F.element_at(labels, F.array_position("__p", best).cast("int")).alias("category"), best.alias("category_conf"))


def confident(classified: DataFrame, least: float = SELF_TRAIN_CONFIDENCE, updates: int = 1) -> DataFrame:
    """The rows sure enough to learn from; none before the model has learnt from any."""
    return classified.where((F.col("category_conf") >= least) & F.lit(updates > 0))


@dataclass
class Engine:
    """The classifier, its second learner, which is trained and never asked, and from how many rows they have learnt."""

    model: PipelineModel | None = None
    second: PipelineModel | None = None
    updates: int = 0

    def save(self, spark: SparkSession, path: str) -> None:
        """Write both models and the count to a folder that all machines share."""
        for name, model in (("model", self.model), ("second", self.second)):
            if model is not None:
                model.write().overwrite().save(f"{path}/{name}")
        spark.createDataFrame([(self.updates, self.model is not None, self.second is not None)], "updates long, model boolean, second boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/state")


def load(spark: SparkSession, path: str) -> Engine:
    state = spark.read.parquet(f"{path}/state").first()
    return Engine(*[PipelineModel.load(f"{path}/{name}") if state[name] else None for name in ("model", "second")], state.updates)


def learn(engine: Engine, samples: DataFrame, replay: DataFrame | None = None, *, rounds: int = 20, dimensions: int = 1 << 18, second: bool = True) -> Engine:
    """An engine that has learnt from ``(text, label)`` rows mixed with replayed ones and the cold start.

    Models are fitted anew, which forgets nothing that is replayed; what they learnt
    before counts on in ``updates``. Without rows the engine stays as it is.
    """
    rows = samples.select("text", "label")
    if replay is not None:
        rows = rows.unionByName(replay.select("text", "label"))
    count = rows.count()
    if not count:
        return engine
    both = rows.unionByName(seed_rows(samples.sparkSession))
    hinge = OneVsRest(classifier=LinearSVC(maxIter=rounds, regParam=0.01), featuresCol="features", labelCol="__y", weightCol="weight")
    return Engine(train(both, None, rounds, dimensions), train(both, None, rounds, dimensions, hinge) if second else None, engine.updates + count)


def load_or_seed(spark: SparkSession, path: str, *, rounds: int = 20, dimensions: int = 1 << 18, second: bool = True) -> Engine:
    """The engine saved under ``path``, or one that has learnt from the cold start and is saved there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/state/_SUCCESS")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return load(spark, path)
    made = train(seed_rows(spark), None, rounds, dimensions)
    hinge = OneVsRest(classifier=LinearSVC(maxIter=rounds, regParam=0.01), featuresCol="features", labelCol="__y", weightCol="weight")
    engine = Engine(made, train(seed_rows(spark), None, rounds, dimensions, hinge) if second else None, len(SEED))
    engine.save(spark, path)
    return engine


def index_documents(documents: DataFrame, engine: Engine, text: str = "text") -> DataFrame:
    """Documents with ``category``, ``category_conf`` and the status INDEXED; one without text is ``Uncategorized`` with 0."""
    bare = documents.drop("category", "category_conf", "status")
    blank = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) == 0
    asked = classify(bare, engine.model if engine.updates else None, text)
    return asked.withColumns({
        "category": F.when(blank, "Uncategorized").otherwise(F.col("category")),
        "category_conf": F.when(blank, 0.0).otherwise(F.col("category_conf")),
        "status": F.lit("INDEXED"),
    })


def correct(classified: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """A user's label wins over the model's."""
    fixed = classified.join(corrections.select(key, F.col("label").alias("__label")), key, "left")
    fixed = fixed.withColumn("category_conf", F.when(F.col("__label").isNotNull(), 1.0).otherwise(F.col("category_conf")))
    return fixed.withColumn("category", F.coalesce("__label", "category")).drop("__label")

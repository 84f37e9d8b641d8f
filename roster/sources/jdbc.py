"""Snapshot of the source relational database over JDBC (S2), renamed to the model and written to Parquet.

Reads are partitioned, so the database is read by many tasks at once, never through the driver: either by uniform
strides of the numeric key column (``partitionColumn`` / ``lowerBound`` / ``upperBound`` / ``numPartitions``), or balanced, by
predicates of equal depth. ``equi_depth`` computes these from the keys: quantiles of the first key column bound the
ranges, and a value of it that alone fills more than a range (a hot student of a link table) is split by quantiles of the second
column. The predicates are disjoint and complete, whatever the keys: every row is read exactly once. Connection
settings always come from the caller; nothing is stored here. No JDBC driver jar ships with this
repository, so tests cover the option building and the renaming only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roster import schema
from roster.sources.tables import Tables

# Table and column names of the source MySQL schema, per model table and column.
SOURCE_NAMES: dict[str, tuple[str, dict[str, str]]] = {
    "phone": ("telefone", {"id": "telefone_PK", "phone": "telefone"}),
    "address": ("endereco", {"id": "endereco_PK", "street": "logradouro", "district": "bairro",
                             "city": "cidade", "complement": "complemento"}),
    "billing_period": ("periodicidade", {"id": "periodicidade_PK", "name": "nome", "days": "qnt_dias"}),
    "invoice_status": ("situacao", {"id": "situacao_PK", "name": "nome"}),
    "sport": ("Esporte", {"id": "id", "name": "nome", "description": "descricao", "is_team": "eh_coletivo"}),
    "schedule": ("HorarioTurma", {"id": "id", "name": "nome"}),
    "time_slot": ("Horario", {"id": "id", "starts_at": "horario_inicio", "ends_at": "horario_fim"}),
    "person": ("Pessoa", {"id": "id", "name": "nome", "tax_id": "cpf", "email": "email", "born_on": "data_nasc",
                          "phone_id": "fk_telefone_telefone_PK", "address_id": "fk_endereco_endereco_PK"}),
    "guardian": ("Responsavel", {"person_id": "fk_Pessoa_id"}),
    "instructor": ("Professor", {"person_id": "fk_Pessoa_id"}),
    "student": ("Aluno", {"person_id": "fk_Pessoa_id", "enrolled_on": "data_matricula",
                          "health_note": "condicao_saude"}),
    "class_group": ("Turma", {"id": "id", "name": "nome", "capacity": "vagas_totais",
                              "schedule_id": "fk_HorarioTurma_id", "sport_id": "fk_Esporte_id"}),
    "session": ("Aula", {"id": "id", "held_on": "data_aula", "was_held": "aula_foi_dada", "class_id": "fk_Turma_id"}),
    "enrollment": ("Matricula_turma", {"id": "id", "student_id": "fk_Aluno_fk_Pessoa_id", "class_id": "fk_Turma_id"}),
    "attendance": ("Frequencia", {"id": "id", "present": "presenca"}),
    "plan": ("PlanoPagamento", {"id": "id", "name": "nome", "amount": "valor",
                                "period_id": "fk_periodicidade_periodicidade_PK", "description": "descricao"}),
    "invoice": ("Mensalidade", {"id": "id", "amount": "valor", "due_on": "data_vencimento",
                                "paid_on": "data_pagamento", "status_id": "fk_situacao_situacao_PK",
                                "pay_method": "forma_pagamento"}),
    "schedule_slot": ("ItemHorario", {"id": "id", "weekday": "int_dia_da_semana", "slot_id": "fk_Horario_id",
                                      "schedule_id": "fk_HorarioTurma_id"}),
    "student_plan": ("PlanoAluno", {"student_id": "fk_Aluno_fk_Pessoa_id", "plan_id": "fk_PlanoPagamento_id"}),
    "cancellation": ("Cancelamento_Aula", {"id": "id", "reason": "justificativa"}),
    "guardianship": ("encarregado", {"student_id": "fk_Aluno_fk_Pessoa_id",
                                     "guardian_id": "fk_Responsavel_fk_Pessoa_id"}),
    "teaches": ("ministra", {"instructor_id": "fk_Professor_fk_Pessoa_id", "class_id": "fk_Turma_id"}),
    "qualified": ("especiliazado", {"sport_id": "fk_Esporte_id", "instructor_id": "fk_Professor_fk_Pessoa_id"}),
}


def jdbc_options(url: str, table: str, properties: dict[str, str] | None = None, partition_column: str | None = None,
                 lower_bound: int | None = None, upper_bound: int | None = None, num_partitions: int | None = None,
                 fetch_size: int = 10_000) -> dict[str, str]:
    opts = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), **(properties or {})}
    if partition_column is not None:
        if lower_bound is None or upper_bound is None or not num_partitions:
            raise ValueError("a partitioned read needs lower_bound, upper_bound and num_partitions")
        opts.update(partitionColumn=partition_column, lowerBound=str(lower_bound), upperBound=str(upper_bound),
                    numPartitions=str(num_partitions))
    return opts


def to_model(df: DataFrame, name: str) -> DataFrame:
    """Rename source columns to the model and cast: BOOLEAN columns read as TINYINT become ``col = 1``
    (a plain cast would also turn 2 into true), FLOAT money becomes decimal(18,2), TIME becomes text."""
    _, cols = SOURCE_NAMES[name]
    out = []
    for f in schema.table(name).schema.fields:
        src = F.col(cols[f.name])
        src_type = df.schema[cols[f.name]].dataType
        if isinstance(f.dataType, T.BooleanType) and not isinstance(src_type, T.BooleanType):
            src = src == 1
        elif isinstance(f.dataType, T.StringType) and not isinstance(src_type, T.StringType):
            src = src.cast("string")
        out.append(src.cast(f.dataType).alias(f.name))
    return df.select(*out)


def read_jdbc_table(spark: SparkSession, name: str, url: str, properties: dict[str, str] | None = None,
                    bounds: tuple[int, int] | None = None, num_partitions: int | None = None) -> DataFrame:
    source_table, cols = SOURCE_NAMES[name]
    pk = schema.table(name).primary_key
    partition = cols[pk[0]] if bounds else None     # a composite key is split on its first column
    opts = jdbc_options(url, source_table, properties, partition, *(bounds or (None, None)),
                        num_partitions if partition else None)
    return to_model(spark.read.format("jdbc").options(**opts).load(), name)


def _ranges(column: str, bounds: list[str]) -> list[str]:
    """Half-open ranges between rising bounds that cover all values."""
    if not bounds:
        return [f"{column} IS NOT NULL"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(bounds, bounds[1:], strict=False)]
    return [f"{column} < {bounds[0]}", *inner, f"{column} >= {bounds[-1]}"]


def _bounds(df: DataFrame, column: str, parts: int) -> list[str]:
    """Up to ``parts`` - 1 distinct inner quantiles of a whole-number column."""
    if parts < 2:
        return []
    cuts = df.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 100 * parts).alias("q")).first().q or []
    return [str(c) for c in sorted(set(cuts))]


def equi_depth(keys: DataFrame, parts: int) -> list[str]:
    """Predicates that split the rows with these keys (the one or two whole-number key columns of a table) into about
    ``parts`` shares of like size, the largest within twice the mean. Pass them to ``spark.read.jdbc(predicates=...)``.

    What reaches the driver is bounded by ``parts``: quantiles, and the values that fill more than a share."""
    first, *second = keys.columns
    total = keys.count()
    if parts < 2 or total <= parts:
        return _ranges(first, []) + [f"{first} IS NULL"]
    share, hot = total / parts, {}
    if second:          # one column alone may be a key, and then no value is hot
        counts = keys.filter(F.col(first).isNotNull()).groupBy(first).count().filter(F.col("count") > share)
        hot = {r[0]: r[1] for r in counts.collect()}        # fewer than ``parts`` values
    others = keys.filter(~F.col(first).isin(list(hot))) if hot else keys
    left = max(1, round((total - sum(hot.values())) / share))
    apart = f" AND {first} NOT IN ({', '.join(map(str, sorted(hot)))})" if hot else ""
    predicates = [p + apart for p in _ranges(first, _bounds(others, first, left))]
    for value, n in sorted(hot.items()):
        within = _bounds(keys.filter(F.col(first) == value), second[0], -(-n // int(share)))
        predicates += [f"{first} = {value} AND {p}" for p in _ranges(second[0], within)]
        predicates.append(f"{first} = {value} AND {second[0]} IS NULL")
    return [*predicates, f"{first} IS NULL"]


def read_balanced(spark: SparkSession, name: str, url: str, predicates: list[str], properties: dict[str, str] | None = None) -> DataFrame:
    """A source table read with one task a predicate (see ``equi_depth``, over the source's column names)."""
    return to_model(spark.read.jdbc(url, SOURCE_NAMES[name][0], predicates=predicates, properties=properties or {}), name)


def source_keys(spark: SparkSession, name: str, url: str, properties: dict[str, str] | None = None,
                bounds: tuple[int, int] | None = None, num_partitions: int | None = None) -> DataFrame:
    """The key columns of a source table, for ``equi_depth``; only these columns are fetched."""
    table, cols = SOURCE_NAMES[name]
    keys = [cols[c] for c in schema.table(name).primary_key][:2]
    opts = jdbc_options(url, table, properties, keys[0] if bounds else None, *(bounds or (None, None)), num_partitions if bounds else None)
    return spark.read.format("jdbc").options(**opts).load().select(*keys)


def jdbc_tables(spark: SparkSession, url: str, properties: dict[str, str] | None = None,
                bounds: dict[str, tuple[int, int]] | None = None, num_partitions: int = 8) -> Tables:
    """All model tables read lazily over JDBC (partitioned where key bounds are given)."""
    b = bounds or {}
    return Tables(spark, {n: (lambda cols, n=n: read_jdbc_table(spark, n, url, properties, b.get(n), num_partitions))
                          for n in schema.TABLE_NAMES})


def snapshot_to_parquet(spark: SparkSession, url: str, root: str, properties: dict[str, str] | None = None,
                        bounds: dict[str, tuple[int, int]] | None = None, num_partitions: int = 8) -> None:
    """Copy every table of the source database into model Parquet folders under ``root`` (new folders;
    the write fails rather than overwrite an existing snapshot)."""
    from roster.sources.parquet import write_tables
    write_tables(jdbc_tables(spark, url, properties, bounds, num_partitions), root)

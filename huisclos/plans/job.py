"""A job from options: detect, decide, number and rewrite under one set of checked options."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detect import Engine
from ..operators.judge import judge_pass
from ..operators.policy import parse
from ..operators.surrogates import apply_surrogates, assign_surrogates
from ..operators.vault import key_table
from ..sources.connectors import Client, Options, http_client
from ..sources.vault_store import VaultStore, people_store
from .materialize import written
from .pseudonymize import KEYS, Protected, pseudonymize


def options_from(settings: Mapping[str, str]) -> Options:
    """Options from texts such as environment variables: ``HUISCLOS_`` and the option's name in capitals; empty ones are absent."""
    given = {k.removeprefix("HUISCLOS_").lower(): v.strip() for k, v in settings.items() if k.startswith("HUISCLOS_") and v.strip()}
    unknown = set(given) - set(Options.__dataclass_fields__)
    if unknown:
        raise ValueError(f"unknown options: {sorted(unknown)}")
    read = {"policies": parse, "engine_threshold": float, "judge_score_min": float, "coreference": yes_or_no, "surrogates": yes_or_no}
    return Options(**{k: read.get(k, str)(v) for k, v in given.items()})


def yes_or_no(text: str) -> bool:
    answers = {"true": True, "1": True, "yes": True, "oui": True, "false": False, "0": False, "no": False, "non": False}
    if text.lower() not in answers:
        raise ValueError(f"not a yes or no: {text!r}")
    return answers[text.lower()]


def run_job(docs: DataFrame, options: Options, policies: DataFrame | None = None, engines: Mapping[str, Engine] | None = None, judge_client: Callable[[], Client] | None = None) -> Protected:
    """``pseudonymize`` under ``options``: the instance's policies for dossiers without an own action for the type, the named engine
    above its threshold (a name that isn't there is an error, not a run without it), and the vault at ``vault_path``, sealed by
    ``vault_key`` or the key in ``vault_key_file``. Of two jobs that began at one version of the vault the second fails. With
    ``coreference`` people are numbered as people, beside the vault too; with ``surrogates`` their placeholders become fake names. With a judge
    every protected text is read by it; a judge that fails leaves kinds of errors and stops nothing.
    """
    if options.engine and options.engine not in (engines or {}):
        raise ValueError(f"no engine {options.engine!r}")
    chosen = [engines[options.engine]] if options.engine else []
    spark = docs.sparkSession
    if options.policies:
        instance = spark.createDataFrame(list(options.policies.items()), "type string, action string")  # one row a type
        everywhere = docs.select("dossier_id").distinct().crossJoin(F.broadcast(instance))
        policies = everywhere if policies is None else everywhere.join(policies, ["dossier_id", "type"], "left_anti").unionByName(policies.select("dossier_id", "type", "action"))
    spark, version, known, people, known_people = docs.sparkSession, 0, None, None, None
    store = vault_of(spark, options)
    if store:
        version = store.version()
        known = written(store.read(docs))
        if options.coreference:
            people = people_store(spark, options.vault_path, store.key)
            people_version, known_people = people.version(), written(people.read(docs))
    done = pseudonymize(docs, policies, known, chosen, options.coreference, known_people, engine_threshold=options.engine_threshold)
    if store:
        if people:  # first: a job that fails between the two leaves people whom the next one knows
            people.append(written(done.people.join(known_people, done.people.columns, "left_anti")), people_version)
        store.append(done.fresh, version)
    if options.surrogates:
        fake = assign_surrogates(done.canonical.where("type = 'PERSONNE'").select("dossier_id", "placeholder").join(named_people(done), ["dossier_id", "placeholder"]), key=options.vault_key)
        done.surrogates = written(fake)
        done.texts = apply_surrogates(done.texts, done.surrogates)
    if options.judge_url:
        client = judge_client or (lambda: http_client(options.judge_url, options.judge_model, seconds=60.0))
        done.judged = judge_pass(done.texts.select(*KEYS, "protected"), client, KEYS, options.judge_answers, model=options.judge_model, score_min=options.judge_score_min)
    return done


def named_people(done: Protected) -> DataFrame:
    """(dossier_id, placeholder, surface) of people, all surfaces."""
    return done.surfaces.where("type = 'PERSONNE'").select("dossier_id", "placeholder", "surface")


def vault_of(spark: SparkSession, options: Options) -> VaultStore | None:
    if not options.vault_path:
        return None
    key = key_table(spark, path=options.vault_key_file) if options.vault_key_file else key_table(spark, options.vault_key)
    return VaultStore(spark, options.vault_path, key)

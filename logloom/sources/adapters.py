"""Rows of known corpora rendered as log lines.

Each corpus is a template: parts joined by spaces, ``{column}`` replaced by its value with
newlines made spaces and absent values empty, then all white space collapsed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse_whitespace
from .readers import read_csv, read_json_items

# Corpus, the columns that it must have besides its template's (a star: all of
# the template's), and the line's template.
LINES = {
    "distsys_synth": ("*", "{Timestamp} {LogLevel} [{Service}] {Message} request_id={RequestID} user={User} client_ip={ClientIP} time_taken={TimeTaken}"),
    "api_failures": ("*", '{timestamp} {log_level} {api_name} {http_method} {endpoint} status={status_code} error_type={error_type} latency_ms={latency_ms} retry={retry_count} retry_ok={is_retry_successful} env={environment} region={region} container={container_id} host={host_id} thread={thread_id} client_ip={client_ip} owner={service_owner} req_bytes={request_size_bytes} resp_bytes={response_size_bytes} msg="{error_message}" root_cause="{root_cause}" resolution="{resolution_action}"'),
    "alibaba_gpu": ("*", "submit_time={submit_time} job={job_name} org={organization} type={job_type} gpu_model={gpu_model} gpu_request={gpu_request} cpu_request={cpu_request} workers={worker_num} duration={duration}"),
    "cicd_failures": ("*", '{timestamp} {severity} {ci_tool} pipeline={pipeline_id} run={run_id} repo={repository} branch={branch} commit={commit_hash} lang={language} os={os} cloud={cloud_provider} stage={failure_stage} failure_type={failure_type} error_code={error_code} build_s={build_duration_sec} test_s={test_duration_sec} deploy_s={deploy_duration_sec} cpu_pct={cpu_usage_pct} mem_mb={memory_usage_mb} retry={retry_count} flaky={is_flaky_test} rollback={rollback_triggered} incident={incident_created} author={author} msg="{error_message}"'),
    "win_events": ("*", "{Data e Hora} {Nível} {Fonte} event_id={Identificação do Evento} task={Categoria da Tarefa} log={Log} computer={Computador} {Description1} {Description2} {Description3}"),
    "syslog_cremev2": ("Time HostName Component Content", "{Time} {HostName} {Component}[{PID_or_IP}]: {Content} tactic={Tactic} technique={Technique}"),
    "servicenow_itsm": ("number incident_state sys_updated_at", "{sys_updated_at} incident={number} state={incident_state} active={active} category={category} subcategory={subcategory} symptom={u_symptom} priority={priority} impact={impact} urgency={urgency} contact={contact_type} group={assignment_group} reassignments={reassignment_count} reopens={reopen_count} mods={sys_mod_count} sla={made_sla} notify={notify} closed_code={closed_code} location={location} ci={cmdb_ci}"),
    "cloudtrail_flaws": ("eventTime eventName eventSource", '{eventTime} {eventName} {eventSource} region={awsRegion} identity_type={userIdentitytype} event_type={eventType} arn={userIdentityarn} user={userIdentityuserName} src_ip={sourceIPAddress} agent="{userAgent}" principal={userIdentityprincipalId} err={errorCode} err_msg="{errorMessage}" req_instance_type={requestParametersinstanceType}'),
    "okta_auth": ("published severity eventType", '{published} {severity} okta event={eventType} msg="{displayMessage}" actor={actor.displayName} actor_id={actor.alternateId} result={outcome.result} reason="{outcome.reason}" ip={client.ipAddress} city={client.geographicalContext.city} ua="{client.userAgent.rawUserAgent}"'),
    "cisco_dns": ("Timestamp Identities InternalIp", "{Timestamp} cisco_umbrella identity={Identities} int_ip={InternalIp} ext_ip={ExternalIp} action={Action} qtype={QueryType} rcode={ResponseCode} domain={Domain} categories={Categories} verdict={Verdict} url={URL}"),
    "crowdstrike_network": ("timestamp EventType ConnectionDirection", '{timestamp} crowdstrike {EventType} dir={ConnectionDirection} local={LocalAddressIP4}:{LocalPort} remote={RemoteAddressIP4}:{RemotePort} proto={Protocol} status={Status} image={ImageFileName} cmd="{CommandLine}" user={UserName} host={ComputerName} technique={Technique}'),
    "crowdstrike_process": ("ProcessStartTime EventType ImageFileName", '{ProcessStartTime} crowdstrike {EventType} image={ImageFileName} cmd="{CommandLine}" parent={ParentBaseFileName} user={UserName} host={ComputerName} technique={Technique}'),
    "crowdstrike_registry": ("timestamp EventType RegObjectName", '{timestamp} crowdstrike {EventType} reg_obj={RegObjectName} reg_val={RegValueName} reg_str="{RegStringValue}" op={RegOperationType} image={ImageFileName} user={UserName} host={ComputerName} technique={Technique}'),
    "proofpoint_email": ("time sender recipient", '{time} proofpoint sender={sender} recipient={recipient} subject="{subject}" from={headerFrom} spam={spamScore} phish={phishScore} mlx_label={mlxLabel} action={action} malware={malwareName} sending_ip={sendingIp}'),
    "zscaler_proxy": ("timestamp user department", '{timestamp} zscaler user={user} dept={department} loc={location} client_ip={clientip} server_ip={serverip} host={hostname} url={url} cat={urlcategory} action={action} method={requestmethod} status={responsecode} ctype={contenttype} ua="{useragent}" threat={threatname} rule={rulelabel} app={appname}'),
    "cloudtrail_synth": ("eventTime eventName eventSource", '{eventTime} {eventName} {eventSource} region={awsRegion} src_ip={sourceIPAddress} identity_type={userIdentity.type} principal={userIdentity.principalId} arn={userIdentity.arn} user={userIdentity.userName} agent="{userAgent}" err={errorCode} bucket={requestParameters.bucketName}'),
}
# Marks of a Python traceback.
TRACE_MARKERS = ("Traceback", 'File "', "Error")


def split_template(template: str) -> list[str]:
    """Text and column names in turn, text first."""
    return re.split(r"\{([^}]+)\}", template)


def template_columns(template: str) -> list[str]:
    return split_template(template)[1::2]


def required(corpus: str) -> tuple[str, ...]:
    need, template = LINES[corpus]
    return tuple(template_columns(template)) if need == "*" else tuple(need.split())


def render(template: str, have: set[str], values: dict[str, Column] | None = None) -> Column:
    """A template as one expression over columns (or ``values``)."""
    parts = []
    for i, x in enumerate(split_template(template)):
        if i % 2 == 0:
            parts.append(F.lit(x))
        elif values and x in values:
            parts.append(F.coalesce(values[x].cast("string"), F.lit("")))
        elif x in have:
            parts.append(F.coalesce(F.translate(F.col(f"`{x}`").cast("string"), "\n\r", "  "), F.lit("")))
    return collapse_whitespace(F.concat(*parts))


def render_corpus(rows: DataFrame, corpus: str) -> DataFrame:
    """(line): the rows of a corpus as log lines; none if a required column is absent."""
    have = set(rows.columns)
    out = rows.select(render(LINES[corpus][1], have).alias("line"))
    return out if set(required(corpus)) <= have else out.limit(0)


def render_tracebacks(items: DataFrame) -> DataFrame:
    """(line): element 3 of each JSON list that has four, where it looks like a traceback."""
    v = F.try_parse_json("item")
    text = F.when(F.size(F.try_variant_get(v, "$", "array<variant>")) >= 4, F.try_variant_get(v, "$[3]", "string"))
    is_text = F.schema_of_variant(F.try_variant_get(v, "$[3]", "variant")) == "STRING"
    marked = F.lit(False)
    for m in TRACE_MARKERS:
        marked = marked | F.contains(text, F.lit(m))
    return items.where(is_text & marked).select(collapse_whitespace(F.translate(text, "\n\r", "  ")).alias("line"))


def stage(spark: SparkSession, corpus: str, source: str, target: str) -> tuple[int, int]:
    """Write a corpus as text lines; (lines written, rows skipped)."""
    if corpus == "python_tracebacks":
        rows = read_json_items(spark, source, "data")
        lines = render_tracebacks(rows)
    else:
        rows = read_csv(spark, source)
        lines = render_corpus(rows, corpus)
    lines.write.mode("overwrite").text(target)
    written = spark.read.text(target).count()
    return written, rows.count() - written


def stage_all(spark: SparkSession, sources: dict[str, str], target: str) -> dict[str, tuple[int, int]]:
    return {corpus: stage(spark, corpus, path, f"{target}/{corpus}") for corpus, path in sources.items()}

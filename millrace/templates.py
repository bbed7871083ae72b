"""Deployment templates as plain data: a serverless stack and a build workflow."""

from __future__ import annotations

from millrace.config import Config
from millrace.operators import schedule


def _function(handler: str, seconds: int, megabytes: int, settings: dict, events: dict) -> dict:
    properties = {"Handler": handler, "Runtime": "python3.12", "Timeout": seconds, "MemorySize": megabytes, "Environment": {"Variables": settings}, "Events": events}
    return {"Type": "AWS::Serverless::Function", "Properties": properties}


def serverless(config: Config, env: str) -> dict:
    """Bucket, table, a function that answers queries and one that ingests on schedule."""
    name = f"{config.project_name}-{env}"
    settings = {"PROJECT": config.project_name, "STAGE": env, "TOP_K": str(config.retrieval.top_k), "METHOD": config.retrieval.method}
    answer = {"Ask": {"Type": "Api", "Properties": {"Path": "/query", "Method": "post"}}} if config.query.endpoint else {}
    runs = {f"Every{i}": {"Type": "Schedule", "Properties": {"Schedule": p["cron_expression"]}} for i, p in enumerate(schedule.plan([vars(s) for s in config.data_sources]))}
    resources = {
        "Documents": {"Type": "AWS::S3::Bucket", "Properties": {"BucketName": f"{name}-documents"}},
        "State": {"Type": "AWS::DynamoDB::Table", "Properties": {"TableName": f"{name}-state", "BillingMode": "PAY_PER_REQUEST", "AttributeDefinitions": [{"AttributeName": "id", "AttributeType": "S"}], "KeySchema": [{"AttributeName": "id", "KeyType": "HASH"}]}},
        "Answer": _function("handlers.query", max(3, config.query.timeout_ms // 1000), 512, settings, answer),
        "Ingest": _function("handlers.ingest", 900, 1024, settings, runs),
    }
    return {
        "AWSTemplateFormatVersion": "2010-09-09", "Transform": "AWS::Serverless-2016-10-31", "Description": f"{config.project_name} ({env})", "Resources": resources,
        "Outputs": {k: {"Value": {"Ref": k}} for k in ("Documents", "State", "Answer")},
    }


def workflow(config: Config, branch: str = "main") -> dict:
    """Tests on every push, deployment of the main branch."""
    run = lambda text: {"run": text}
    setup = [{"uses": "actions/checkout@v4"}, {"uses": "actions/setup-python@v5", "with": {"python-version": "3.12"}}, run("pip install -r requirements.txt")]
    deploy = {"needs": "test", "if": f"github.ref == 'refs/heads/{branch}'", "runs-on": "ubuntu-latest", "steps": [*setup, run("sam build"), run(f"sam deploy --stack-name {config.project_name} --no-confirm-changeset")]}
    return {"name": f"Build {config.project_name}", "on": {"push": {"branches": [branch]}, "pull_request": {}}, "jobs": {"test": {"runs-on": "ubuntu-latest", "steps": [*setup, run("pytest")]}, "deploy": deploy}}

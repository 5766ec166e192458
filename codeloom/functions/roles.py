"""Role tags of declarations, by the decorators, supertypes and paths that frameworks give them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (role, decorator names, supertype names, path patterns); the first that fits wins. A leading * takes any
# beginning; a decorator fits by its whole name or its last part, whatever its case in the first letter.
ROLES: list[tuple[str, list[str], list[str], list[str]]] = [
    ("route_handler", ["get", "post", "put", "delete", "patch", "head", "options", "route", "websocket", "api_view", "action"], [], []),
    ("route_handler", ["GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping", "RequestMapping", "HttpGet", "HttpPost", "HttpPut", "HttpDelete", "HttpPatch", "Path"], [], []),
    ("route_handler", ["RestController", "Controller", "ApiController", "Resolver", "WebServlet"], [], []),
    ("route_handler", [], ["*Controller", "ControllerBase", "HttpServlet", "APIView", "*ViewSet", "RequestHandler", "MethodView", "Resource"], []),
    ("page_component", ["customElement"], ["StatelessWidget", "StatefulWidget", "LightningElement"], []),
    ("cli_command", ["command", "group", "CommandLine.Command", "Command"], ["BaseCommand", "Command", "Thor"], ["%/management/commands/%.py"]),
    ("background_job", ["task", "shared_task", "periodic_task", "cron", "Cron", "Scheduled", "Job", "job", "Processor"], ["BackgroundService", "IHostedService", "ApplicationJob", "ShouldQueue", "*Job", "*Worker"], []),
    ("event_listener", ["EventListener", "KafkaListener", "RabbitListener", "JmsListener", "EventHandler", "OnEvent", "receiver", "listens_for", "Subscribe", "MessagePattern", "EventPattern"], ["INotificationHandler", "ApplicationListener", "*Consumer", "*Listener", "IConsumer"], []),
    ("middleware", ["middleware", "before_request", "after_request", "ControllerAdvice", "Catch"], ["*Middleware", "OncePerRequestFilter", "NestMiddleware", "CanActivate", "NestInterceptor", "ActionFilterAttribute", "HandlerInterceptor"], []),
]
# Files that start a process.
BOOTSTRAP = ["main.py", "__main__.py", "manage.py", "wsgi.py", "asgi.py", "setup.py", "conftest.py", "main.go", "main.rs", "build.rs", "main.ts", "main.js", "index.js", "server.js", "server.ts", "Program.cs", "Startup.cs", "Main.java", "Application.java", "main.dart", "main.swift", "Main.kt", "Application.kt"]
MAINS = ["main", "Main"]


def _name_test(patterns: list[str], name: Column) -> Column:
    """Whether a name, without generics, is one of the patterns, whole or by its last part."""
    last = F.element_at(F.split(F.regexp_replace(name, "[<\\[(].*$", ""), r"[.:]+"), -1)
    whole = [re.escape(p) for p in patterns if not p.startswith("*")]
    ends = [re.escape(p[1:]) for p in patterns if p.startswith("*")]
    return last.rlike("^(?:" + "|".join([*whole, *(f".*{e}" for e in ends)]) + ")$")


def _any_named(patterns: list[str], names: Column) -> Column:
    return F.exists(names, lambda n: _name_test(patterns, n))


def role_of(decorators: Column, bases: Column, path: Column) -> Column:
    """The role tag of a declaration with these decorators and supertypes (arrays of names); null for none."""
    tests = []
    for role, names, supers, paths in ROLES:
        fits = []
        if names:
            fits.append(_any_named(names, decorators))
        if supers:
            fits.append(_any_named(supers, bases))
        fits += [path.like(p) for p in paths]
        tests.append(F.when(reduce(lambda a, b: a | b, fits), F.lit(role)))
    return F.coalesce(*tests)


def is_bootstrap(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1).isin(BOOTSTRAP)

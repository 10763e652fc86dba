"""Links to logs, pages and tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runledger.functions.names import _col

NO_LINK = "NA"


def log_link(
    host: Column | str, container: Column | str, usr: Column | str, node_address: Column | str | None
) -> Column:
    """Container log link; ``NA`` without a user or without ``:port`` in the node address."""
    if node_address is None:
        return F.lit(NO_LINK)
    port = F.get(F.split(_col(node_address), ":"), F.lit(1))
    link = F.concat(
        F.lit("http://"), _col(host), F.lit(":"), port, F.lit("/node/containerlogs/"),
        _col(container), F.lit("/"), _col(usr),
    )
    return F.coalesce(F.when(F.nullif(port, F.lit("")).isNotNull(), link), F.lit(NO_LINK))


def app_links(app_id: Column | str) -> Column:
    """Ordered map of the links shown for an application."""
    app_id = _col(app_id)
    return F.create_map(
        F.lit("Events"), F.concat(F.lit("/jobs/"), app_id), F.lit("Logs"), F.concat(F.lit("/logs/"), app_id)
    )


def config_link(app_id: Column | str) -> Column:
    return F.concat(F.lit("/config/"), _col(app_id))


def cluster_app_url(app_id: Column | str, address: str) -> Column:
    return F.concat(F.lit(f"http://{address}/cluster/app/"), _col(app_id))


def with_scheme(url: Column | str) -> Column:
    url = _col(url)
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("http://"), url))


def task_url(node: Column | str, container: Column | str, usr: Column | str) -> Column:
    return F.concat(
        F.lit("http://"), _col(node), F.lit("/node/containerlogs/"), _col(container), F.lit("/"), _col(usr)
    )


def portal_link(portal: Column | str, app_id: Column | str) -> Column:
    return F.concat(_col(portal), F.lit("/jobs/"), _col(app_id))

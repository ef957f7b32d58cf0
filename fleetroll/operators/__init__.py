from .columns import (
    apply_overrides,
    child_namespaces,
    ensure_request_ids,
    flatten_properties,
    ids_from_paths,
    mint_instance_ids,
    outcome_codes,
    parse_instance_ids,
    parse_statuses,
    qualify_uris,
    render_properties,
)
from .config import layered_config
from .correlate import completion_barrier, correlate_responses, first_terminal_state, join_deadlines, orphan_responses
from .deploy import cyclic_slots, deploy_status_log, expand_deploys, match_offers, submitted_instances
from .lifecycle import (
    auto_down,
    auto_down_carry,
    fleet_carry,
    fleet_state,
    fleet_transitions,
    heartbeat_liveness,
    launch_timeouts,
    match_members,
    outage_terminations,
    registration_attempts,
    rejected_updates,
    unreachable_episodes,
)
from .registry import (
    exclude_container,
    filter_answers,
    get_containers,
    get_instances,
    instances_by,
    instances_by_hybrid,
    instances_by_requests,
    known_instances,
    last_by_key,
    list_containers,
    list_instances,
    members_with_role,
    reconcile_snapshot,
    register_if_absent,
    resolve_terminations,
    seed_nodes,
)

__all__ = [name for name in dir() if not name.startswith("_")]

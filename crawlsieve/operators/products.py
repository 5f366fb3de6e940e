"""Products of each page from its structured data (F26-F28) and their checks."""

from __future__ import annotations

from ..functions.sql import any_of, each, first, first_value, fresh, keep, let, lit
from ..functions.text import MAX_URL, number_text
from ..functions.urls import serialise, without_fragment
from ..functions.variant import amount, as_list, as_map, as_objects, as_string, given, key, text, text_value
from .families import meta_content, og
from .issues import NO_ISSUES, issue, per, when
from .jsonld import by_id, name_of

IDENTIFIERS = ("gtin", "gtin8", "gtin12", "gtin13", "gtin14", "isbn")
MAP = "MAP<STRING, VARIANT>"


def _resolved(entry: str) -> str:
    """An object with what the node it refers to says, its own values first."""
    base = by_id(as_string(key(entry, "@id")))
    return let(base, lambda b: (f"CASE WHEN {b} IS NULL THEN {entry} ELSE map_concat(map_filter({b}.m, (k, v) -> NOT map_contains_key({entry}, k)), {entry}) END"))


def _is_product(o: str) -> str:
    return f"(array_contains({o}.types, 'Product') OR array_contains({o}.types, 'ProductGroup'))"


def _is_group(o: str) -> str:
    return f"array_contains({o}.types, 'ProductGroup')"


def _is_organization(o: str) -> str:
    return f"exists({o}.types, t -> t IN ('Organization', 'Corporation') OR t RLIKE '(Store|Business)$')"


def _spec(offer: str, name: str) -> str:
    return let(first(as_objects(key(offer, "priceSpecification"))), lambda s: f"CASE WHEN {s} IS NOT NULL THEN {key(s, name)} END")


def _offer(entry: str) -> str:
    """What the checks and facts read of one offer."""
    def read(o: str) -> str:
        prices = keep(f"array({amount(key(o, 'price'))}, {amount(_spec(o, 'price'))}, {amount(key(o, 'lowPrice'))}, {amount(key(o, 'highPrice'))})",
                      lambda p: f"{p} IS NOT NULL")
        currency = f"coalesce({text_value(key(o, 'priceCurrency'))}, {text_value(_spec(o, 'priceCurrency'))})"
        available = f"nullif(regexp_replace({text_value(key(o, 'availability'))}, '(?i)^https?://schema\\\\.org/', ''), '')"
        aggregate = f"coalesce(exists({as_list(key(o, '@type'))}, t -> {as_string('t')} = 'AggregateOffer'), false)"
        return (f"named_struct('prices', {prices}, 'currency', {currency}, 'availability', {available}, 'aggregate', {aggregate}, "
                f"'sku', {text_value(key(o, 'sku'))}, 'gtin', {_gtin(o)}, 'mpn', {text_value(key(o, 'mpn'))}, "
                f"'ships', {given(key(o, 'shippingDetails'))}, 'returns', {given(key(o, 'hasMerchantReturnPolicy'))})")
    return let(_resolved(entry), read)


def _gtin(m: str) -> str:
    return f"coalesce({', '.join(text_value(key(m, k)) for k in IDENTIFIERS)})"


def _image(value: str) -> str:
    one = lambda i: let(as_map(i), lambda m: (
        f"CASE WHEN {m} IS NULL THEN {text(i, MAX_URL)} ELSE coalesce({text_value(key(m, 'url'), MAX_URL)}, {text_value(key(m, 'contentUrl'), MAX_URL)}) END"))
    return first_value(each(as_list(value), one))


def _member(m: str) -> str:
    """One node or variant: the values a product takes from the first member that gives them."""
    brand = first_value(each(as_list(key(m, "brand")), name_of))
    return (f"named_struct('brand', {brand}, 'sku', {text_value(key(m, 'sku'))}, 'gtin', {_gtin(m)}, 'mpn', {text_value(key(m, 'mpn'))}, "
            f"'image', {_image(key(m, 'image'))}, 'offers', {each(as_objects(key(m, 'offers')), _offer)})")


def _product_url(value: str) -> str:
    """The address that names a product: without fragment and without the variant parameter."""
    plain = let(serialise(value), lambda u: (
        f"regexp_replace(regexp_replace({without_fragment(u)}, '([?&])variant=[^&]*(&|$)', '$1'), '[?&]$', '')"))
    return let(value, lambda v: f"CASE WHEN {v} IS NOT NULL THEN coalesce({plain.replace(value, v)}, {v}) END")


def offer_summary(offers: str) -> str:
    """Price range in the first priced currency, and availability."""
    priced = keep(offers, lambda o: f"size({o}.prices) > 0")
    def summary(ps: str) -> str:
        def ranged(c: str) -> str:
            prices = f"flatten(transform(filter({ps}, o -> o.currency <=> {c}), o -> o.prices))"
            any_currency = first_value(f"transform({offers}, o -> o.currency)")
            return let(prices, lambda xs: (
                f"named_struct('count', size({offers}), 'low_price', array_min({xs}), 'high_price', array_max({xs}), "
                f"'price_currency', CASE WHEN size({xs}) > 0 THEN {c} ELSE {any_currency} END, "
                f"'availability', slice(array_distinct(filter(transform({offers}, o -> o.availability), a -> a IS NOT NULL)), 1, 5))"))
        return let(first_value(f"transform({ps}, o -> o.currency)"), ranged)
    return f"CASE WHEN size({offers}) > 0 THEN {let(priced, summary)} END"


def _rating(m: str) -> str:
    def read(a: str) -> str:
        value = amount(key(a, "ratingValue"))
        count = f"coalesce({amount(key(a, 'reviewCount'))}, {amount(key(a, 'ratingCount'))})"
        return let(f"CASE WHEN {a} IS NOT NULL THEN {value} END", lambda v: f"CASE WHEN {v} IS NOT NULL THEN named_struct('value', {v}, 'count', {count}) END")
    return let(first(as_objects(key(m, "aggregateRating"))), read)


def stages() -> list[dict[str, str]]:
    """``products_all``: every product of the page, a group with its variants counted once."""
    parent_id = lambda o: let(first(as_objects(key(f"{o}.m", "isVariantOf"))), lambda v: f"CASE WHEN {v} IS NOT NULL THEN {as_string(key(v, '@id'))} END")
    ld_products = each(keep("ld_objects", _is_product), lambda o: (
        f"named_struct('o', {o}, 'is_group', {_is_group(o)}, 'group_ord', {let(by_id(parent_id(o)), lambda g: f'CASE WHEN {_is_group(g)} THEN {g}.ord END')})"))
    # Variants of each group: inline or referred to by it, then products that name it.
    def of_group(g: str) -> str:
        def joined(inline: str) -> str:
            ids = f"transform({inline}, v -> {as_string(key('v', '@id'))})"
            named = keep("ld_products", lambda p: (f"NOT {p}.is_group AND {p}.group_ord = {g}.o.ord AND NOT coalesce(array_contains({ids}, {p}.o.id), false)"))
            return f"named_struct('ord', {g}.o.ord, 'variants', concat({inline}, transform({named}, p -> p.o.m)))"
        return let(each(as_objects(key(f"{g}.o.m", "hasVariant")), _resolved), joined)
    ld_groups = each(keep("ld_products", lambda p: f"{p}.is_group"), of_group)
    variant_ids = f"flatten(transform(ld_groups, g -> transform(g.variants, v -> {as_string(key('v', '@id'))})))"
    tops = keep("ld_products", lambda p: (
        f"{p}.is_group OR ({p}.group_ord IS NULL AND NOT coalesce(array_contains(ld_variant_ids, {p}.o.id), false))"))
    def members(p: str) -> str:
        own = f"coalesce(get(filter(ld_groups, g -> g.ord = {p}.o.ord), 0).variants, CAST(array() AS ARRAY<{MAP}>))"
        return f"named_struct('o', {p}.o, 'members', {each(f'concat(array({p}.o.m), {own})', _member)})"
    orgs = lambda name: any_of("ld_objects", lambda o: f"size({o}.types) > 0 AND {_is_organization(o)} AND {given(key(o + '.m', name))}")
    def describe(p: str) -> str:
        offers = f"flatten(transform({p}.members, m -> m.offers))"
        def fact(os: str) -> str:
            m = f"{p}.o.m"
            of_member = lambda f: first_value(f"transform({p}.members, x -> x.{f})")
            either = lambda f: f"coalesce({of_member(f)}, {first_value(f'transform({os}, x -> x.{f})')})"
            place = lambda flag, org: f"CASE WHEN exists({os}, x -> x.{flag}) THEN 'offer' WHEN {orgs(org)} THEN 'organization' END"
            return (f"named_struct('id', {p}.o.id, 'url', {_product_url(text_value(key(m, 'url'), MAX_URL))}, 'offer_list', {os}, 'types', {p}.o.types, "
                    f"'name', {text_value(key(m, 'name'))}, 'brand', {of_member('brand')}, 'sku', {either('sku')}, 'gtin', {either('gtin')}, "
                    f"'mpn', {either('mpn')}, 'image', {of_member('image')}, 'offers', {offer_summary(os)}, "
                    f"'shipping', {place('ships', 'hasShippingService')}, 'return_policy', {place('returns', 'hasMerchantReturnPolicy')}, "
                    f"'rating', {_rating(m)})")
        return let(offers, fact)
    shown = ("types", "name", "brand", "sku", "gtin", "mpn", "image", "offers", "shipping", "return_policy", "rating")
    # Products of one page that are the same one: each joins the groups it shares an id, url or name with.
    g, p, acc = fresh("g"), fresh("p"), fresh("acc")
    index = (f"aggregate(sequence(0, size(products_all) - 1), CAST(array() AS ARRAY<ARRAY<INT>>), ({acc}, {p}) -> "
             f"concat(filter({acc}, {g} -> NOT {_shares(g, p)}), array(concat(flatten(filter({acc}, {g} -> {_shares(g, p)})), array({p})))))")
    return [
        {"ld_products": ld_products},
        {"ld_groups": ld_groups},
        {"ld_variant_ids": f"filter({variant_ids}, i -> i IS NOT NULL)"},
        {"ld_tops": each(tops, members)},
        {"products_all": each("ld_tops", describe)},
        {
            "products": f"transform(slice(products_all, 1, 10), p -> named_struct({', '.join(f'{lit(f)}, p.{f}' for f in shown)}))",
            "product_groups": f"CASE WHEN size(products_all) = 0 THEN CAST(array() AS ARRAY<ARRAY<INT>>) ELSE {index} END",
        },
    ]


def _shares(group: str, i: str) -> str:
    k = fresh("k")
    a, b = f"products_all[{k}]", f"products_all[{i}]"
    same = f"coalesce({a}.id = {b}.id OR {a}.url = {b}.url OR lower({a}.name) = lower({b}.name), false)"
    return f"exists({group}, {k} -> {same})"


# --- checks ---------------------------------------------------------------------------------------------------------

def _context(p: str) -> str:
    return f"CASE WHEN {p}.name IS NOT NULL THEN concat('\"name\": \"', {p}.name, '\"') ELSE concat('\"@type\": \"', array_join({p}.types, ', '), '\"') END"


def _offer_gaps(p: str) -> str:
    def gaps(listed: str) -> str:
        priced = keep(listed, lambda o: f"exists({o}.prices, x -> x > 0)")
        some = lambda xs: f"exists({xs}, o -> o.currency IS NOT NULL)"
        def judge(pr: str) -> str:
            rest = (f"CASE WHEN size({listed}) = 0 THEN array('an Offer (an AggregateOffer is not enough)') ELSE "
                    f"filter(array(CASE WHEN size({pr}) = 0 THEN 'a price above 0' END, "
                    f"CASE WHEN size({pr}) > 0 AND NOT {some(pr)} THEN 'a priceCurrency in the Offer with the price' END, "
                    f"CASE WHEN size({pr}) = 0 AND NOT {some(listed)} THEN 'a priceCurrency' END), g -> g IS NOT NULL) END")
            return f"concat(CASE WHEN {p}.image IS NULL THEN array('an image') ELSE array() END, {rest})"
        return let(priced, judge)
    return let(keep(f"{p}.offer_list", lambda o: f"NOT {o}.aggregate"), gaps)


def checks() -> str:
    """Checks of the product a page is about, then conflicts between nodes of one product."""
    sole = keep("transform(product_groups[0], i -> products_all[i])", lambda p: f"{p}.offers IS NOT NULL")
    site_names = (f"concat(transform(filter(ld_objects, o -> {_is_organization('o')} OR array_contains(o.types, 'WebSite')), "
                  f"o -> {text_value(key('o.m', 'name'))}), array({meta_content(og('site_name'))}))")
    def single(p: str) -> str:
        incomplete = let(_offer_gaps(p), lambda gs: when(f"size({gs}) > 0", issue(
            "product-offer-incomplete", f"concat('Product has offers but lacks ', array_join({gs}, ', '))", _context(p))))
        absent = (f"filter(array(CASE WHEN {p}.brand IS NULL THEN 'brand' END, CASE WHEN {p}.gtin IS NULL AND {p}.mpn IS NULL THEN 'an identifier (gtin or mpn)' END, "
                  f"CASE WHEN size({p}.offers.availability) = 0 THEN 'availability' END, CASE WHEN {p}.shipping IS NULL THEN 'shippingDetails' END, "
                  f"CASE WHEN {p}.return_policy IS NULL THEN 'hasMerchantReturnPolicy' END), g -> g IS NOT NULL)")
        details = let(absent, lambda gs: when(f"size({gs}) > 0", issue(
            "product-details-missing", f"concat('Product leaves out ', array_join({gs}, ', '))", _context(p))))
        brand = when(f"coalesce(exists({site_names}, n -> lower(n) = lower({p}.brand)), false)", issue(
            "product-brand-is-site", f"concat('Brand \"', {p}.brand, '\" is the name of the site')", f"concat('\"brand\": \"', {p}.brand, '\"')"))
        return f"concat({incomplete}, {details}, {brand})"
    def distinct(xs: str) -> str:
        x, i, y = fresh("x"), fresh("i"), fresh("y")
        return f"filter({xs}, ({x}, {i}) -> NOT exists(slice({xs}, 1, {i}), {y} -> {y}.type = {x}.type AND {y}.message = {x}.message))"
    about = f"CASE WHEN size(product_groups) = 1 THEN {let(per(sole, single), distinct)} ELSE {NO_ISSUES} END"
    num = number_text
    compared = (
        ("price", lambda p: f"CASE WHEN {p}.offers.low_price IS NOT NULL THEN CASE WHEN {p}.offers.low_price = {p}.offers.high_price THEN {num(p + '.offers.low_price')} "
                            f"ELSE concat({num(p + '.offers.low_price')}, '-', {num(p + '.offers.high_price')}) END END"),
        ("currency", lambda p: f"{p}.offers.price_currency"),
        ("rating", lambda p: f"{num(p + '.rating.value')}"),
    )
    def conflict(ns: str) -> str:
        differ = [let(f"array_distinct(filter({each(ns, read)}, v -> v IS NOT NULL))",
                      lambda vs, f=field: f"CASE WHEN size({vs}) > 1 THEN concat('{f} (', array_join({vs}, ' vs '), ')') END") for field, read in compared]
        named_node = f"coalesce(get(filter({ns}, n -> n.name IS NOT NULL), 0), {ns}[0])"
        def judge(ds: str) -> str:
            return let(named_node, lambda n: when(f"size({ds}) > 0", issue(
                "conflicting-product-data", f"concat(size({ns}), ' Product nodes for ', CASE WHEN {n}.name IS NULL THEN 'one product' ELSE concat('\"', {n}.name, '\"') END, "
                f"' disagree on ', array_join({ds}, ', '))", _context(n))))
        return f"CASE WHEN size({ns}) < 2 THEN {NO_ISSUES} ELSE {let(f'filter(array({', '.join(differ)}), d -> d IS NOT NULL)', judge)} END"
    conflicts = per("product_groups", lambda g: let(f"transform({g}, i -> products_all[i])", conflict))
    return f"CASE WHEN size(products_all) = 0 THEN {NO_ISSUES} ELSE concat({about}, {conflicts}) END"

"""The columns of a lead, in the order of the export (fixed values)."""

from __future__ import annotations

LEAD_COLUMNS = (
    "place_id business_name category phone phone_international website address full_address city state postal_code country latitude longitude plus_code google_maps_url rating review_count claimed_status business_status "
    "business_hours cover_image_url latest_image_upload by_owner_photos has_recent_post latest_post_date source_query source_location source_keyword website_status website_failure_reason emails email_count facebook instagram "
    "linkedin youtube twitter_x tiktok pinterest github snapchat tech_stack cms analytics tag_manager meta_pixel ga4 gtm advertising booking_system chat_widget ssl signal_pricing signal_financing signal_licensed_insured "
    "signal_established signal_portfolio signal_mobile_service signal_membership sentiment_score review_keywords lead_score pitch_hook top_review decision_maker_name decision_maker_title mx_status mx_reason smtp_status smtp_reason record_id"
).split()
SOCIAL_COLUMNS = "facebook instagram linkedin youtube twitter_x tiktok pinterest github snapchat".split()
MISSING = "N/A"
